"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their MinHash signatures don't
compare. Instead an item's sketch, its K least shingle hashes, is looked up
among all shingles of a document. Items are partitioned by size, in classes
whose sizes differ by less than twice, and K comes from the class's upper
bound: so large that an item which a document contains to the threshold must have
one of them in it. So the search loses nothing, and what it finds is verified by
exact containment of the shingles themselves.

Plan: shingle hashes of each text are exploded and joined with the sketches,
which are broadcast while they are small (BROADCAST_ROWS, BROADCAST_BYTES) and shuffled otherwise;
the texts of candidates alone are read again for the verification.

Defined cases: a null or empty item is in no document; an item of fewer words
than n is one shingle of all its words; repeated rows of one id and text give
each pair once; null ids are ids like others; a very long text is exploded shingle by
shingle, and nothing of it is cut; other columns of any name play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ascii_lower, words, written

#: A side of a join is broadcast up to so many rows and so many bytes of its values as JSON.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 2**20


def _runs(width: Column, w: Column, n: int, make) -> Column:
    """make() over the words of each run of `width` words, at most n."""
    return F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: make([F.when(F.lit(k) < width, F.get(w, i + k)) for k in range(n)]),
    )


def items_of(bench: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """__item, id, width of the shingles, and their distinct texts and hashes, for items with words."""
    rows = bench.select(F.col(f"`{id_col}`").alias("id"), words(ascii_lower(F.col(f"`{text_col}`"))).alias("w")).distinct()
    rows = rows.where(F.size("w") > 0).withColumn("width", F.least(F.lit(n), F.size("w")))
    texts = F.array_distinct(_runs(F.col("width"), F.col("w"), n, lambda ws: F.concat_ws(" ", *ws)))
    rows = rows.select("id", "w", "width", texts.alias("shingles"))
    hashes = F.transform("shingles", lambda s: F.xxhash64(F.col("width"), s))
    return rows.select(F.xxhash64("id", "w").alias("__item"), "id", "width", "shingles", hashes.alias("hashes"))


def sketches(items: DataFrame, num: int, den: int) -> DataFrame:
    """h and __item: the K least hashes of each item, K by its size class."""
    size = F.size("shingles")
    bound = F.pow(F.lit(2), F.floor(F.log2(size.cast("double"))) + 1).cast("int") - 1
    k = bound - F.ceil(bound * num / den).cast("int") + 1
    least = F.slice(F.sort_array(F.transform("hashes", lambda h: F.struct(F.xxhash64(h).alias("rank"), h.alias("h")))), F.lit(1), k)
    return items.select("__item", F.explode(F.transform(least, lambda x: x["h"])).alias("h"))


def _hashes(w: str, width: int) -> Column:
    """Hashes of all runs of `width` words, as in items_of."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(F.lit(width), F.concat_ws(" ", *[F.get(F.col(w), i + k) for k in range(width)])),
    )
    return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _sided(df: DataFrame) -> DataFrame:
    """df, which is written, to be broadcast if it is within both bounds."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def leaks(
    docs: DataFrame, bench: DataFrame, n: int = 5, num: int = 80, den: int = 100,
    doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", text_hash: str | None = None,
) -> DataFrame:
    """doc_id, item_id, n_shingles (distinct ones of the item), n_shared and containment of each pair from num/den on.

    With text_hash, a column of that name has the hash of the document's text, for without_leaks.
    """
    items = written(items_of(bench, n, item_id, text_col), "leak-items")
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]  # n at most
    text = F.col(f"`{text_col}`")
    if not widths:
        kinds = (docs.schema[doc_id].dataType.simpleString(), bench.schema[item_id].dataType.simpleString())
        hashed = f", `{text_hash}` long" if text_hash else ""
        return docs.sparkSession.createDataFrame([], f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, n_shingles long, n_shared long, containment double{hashed}")
    sketch = written(sketches(items, num, den), "leak-sketches")
    base = docs.select(F.col(f"`{doc_id}`").alias("d"), F.xxhash64(text).alias("t"), words(ascii_lower(text)).alias("w"))
    hashes = F.concat(*[_hashes("w", k) for k in widths])
    seen = base.select("d", "t", F.explode(hashes).alias("h"))
    found = seen.join(_sided(sketch), "h").select("d", "t", "__item")
    by_doc = written(found.groupBy("d", "t").agg(F.collect_set("__item").alias("found")), "leak-candidates")
    # Texts of candidates, each with its few items.
    again = docs.select(F.col(f"`{doc_id}`").alias("d2"), F.xxhash64(text).alias("t2"), text.alias("text"))
    side = _sided(by_doc)
    again = again.join(side, F.col("d2").eqNullSafe(F.col("d")) & (F.col("t2") == F.col("t"))).select("d", "t", "found", "text")
    again = again.select("d", "t", "found", words(ascii_lower(F.col("text"))).alias("w"))
    own = F.array_distinct(F.flatten(F.array(*[_texts("w", k) for k in widths])))
    pairs = again.select("d", "t", own.alias("own"), F.explode("found").alias("__item"))
    facts = items.select("__item", "id", "shingles")
    both = pairs.join(_sided(facts), "__item")
    both = both.select("d", "t", "id", F.size("shingles").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).cast("bigint").alias("n_shared"))
    kept = both.where(F.col("n_shared") * den >= F.col("n_shingles") * num).distinct()
    return kept.select(
        F.col("d").alias(doc_id), F.col("id").alias(item_id), "n_shingles", "n_shared",
        F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"), *([F.col("t").alias(text_hash)] if text_hash else []),
    )


def _texts(w: str, width: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *[F.get(F.col(w), i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<string>"))


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text_col: str = "text", text_hash: str = "__text") -> DataFrame:
    """The rows of docs whose id and text are in no leak; found comes from leaks with text_hash. Null ids are ids like others."""
    gone = written(found.select(F.col(f"`{doc_id}`").alias("__d"), F.col(f"`{text_hash}`").alias("__t")).distinct(), "leak-ids")
    same = docs[doc_id].eqNullSafe(F.col("__d")) & (F.xxhash64(docs[text_col]) == F.col("__t"))
    return docs.join(_sided(gone), same, "left_anti")
