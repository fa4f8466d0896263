"""WARC records and a Merkle fixity audit of their replicas.

Records are hashed where they lie; only digests, lengths and places move. A
record's place is its id; FANOUT neighbouring places make a range, FANOUT
ranges a wider one, up to one root, and each node's digest is over its children
in order. FANOUT^2 places make a file, in which records have byte offsets. An
audit compares the roots and ends there if they are equal; else it goes down level
by level. What differs on a level is written, and of the next one only nodes below
it are read: levels are stored in order of their keys, and the filter on the keys'
bounds reaches the Parquet scan, which skips files and pages outside of them.

Scale: a node has at most FANOUT children, each level is FANOUT times smaller,
and there are log(places) levels. Rows of one place are combined by sums of
their digests' words, which partial aggregation adds up, however many they are.
The bounds that the driver holds are RANGES pairs at most; wider ones stand for
more mismatches, and a join on the parent makes the choice exact.

Defined cases: null urls and bodies are empty; a null id takes a negative place
by the hash of its record; rows of one id make one place, whose digest doesn't
depend on their order; an empty table has no root and equals an empty replica;
records of any length are hashed whole, up to the 2 GB of one value in Spark.
Other columns of the pages are left out, whatever their names.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import whole, written

#: Children of a node.
FANOUT = 64
#: Places of a file.
FILE_PLACES = FANOUT**2
#: Pairs of bounds that a filter has at most.
RANGES = 256
#: Mismatching nodes are sent to all executors up to this number.
BROADCAST_ROWS = 200_000
#: Places from null ids are spread over so many.
NULL_PLACES = 1 << 40
#: The date in all records made here.
DATE = "2024-01-01T00:00:00Z"


def record(id_: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as bytes."""
    data = F.encode(whole(body), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), whole(url),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"), whole(id_),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(data).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), data, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """id and record (bytes)."""
    c = lambda n: F.col(f"`{n}`")
    return pages.select(c(id_col).cast("bigint").alias("id"), record(c(id_col), c(url_col), c(body_col)).alias("record"))


def containers(recs: DataFrame) -> DataFrame:
    """file and content: the bytes of each WARC file, at most FILE_PLACES places in it."""
    placed = recs.select(_place(F.col("id"), F.sha2("record", 256)).alias("place"), "record")
    byfile = placed.groupBy(F.floor(F.col("place") / FILE_PLACES).cast("bigint").alias("file"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda x: x["record"])
    return byfile.agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a WARC file's bytes."""
    at = 0
    while m := _HEAD.match(content, at):
        pairs = (line.partition(b":") for line in m[1].split(b"\r\n"))
        headers = {k.decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}
        end = m.end() + int(headers["Content-Length"])
        yield at, end + 4 - at, headers, content[m.end() : end]
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """id, offset, record of all WARC files below a path that Spark can read; id is the record's ordinal in its file.

    Files ending in .gz are unpacked, offsets being those of the unpacked bytes. A
    file is one value: at most 2 GB, and as much memory in its task.
    """

    def run(batches):
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                c = gzip.decompress(c) if p.endswith(".gz") else c
                found = [(p, i, o, c[o : o + n]) for i, (o, n, _, _) in enumerate(parse(c))]
                yield type(batch)(found, columns=["file", "id", "offset", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, id long, offset long, record binary")


def _place(id_: Column, digest: Column) -> Column:
    return F.coalesce(id_.cast("bigint"), -1 - F.pmod(F.xxhash64(digest), F.lit(NULL_PLACES)))


def leaves(recs: DataFrame) -> DataFrame:
    """key (place), digest, n (records) and bytes of each place."""
    hashed = recs.select("id", F.sha2("record", 256).alias("h"), F.octet_length("record").cast("bigint").alias("bytes"))
    word = lambda k: F.conv(F.substring("h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")
    summed = hashed.groupBy(_place(F.col("id"), F.col("h")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), *[F.sum(word(k)).alias(f"w{k}") for k in range(4)]
    )
    return summed.select("key", F.sha2(F.concat_ws(":", "n", "bytes", "w0", "w1", "w2", "w3"), 256).alias("digest"), "n", "bytes")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the digest of a range is over its children's keys and digests in order."""
    children = F.sort_array(F.collect_list(F.struct("key", "digest")))
    text = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["key"].cast("string"), x["digest"])), ",")
    return nodes.groupBy(F.floor(F.col("key") / FANOUT).cast("bigint").alias("key")).agg(
        F.sha2(text, 256).alias("digest"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")
    )


def _stored(nodes: DataFrame, name: str) -> DataFrame:
    """A level, written so that neighbouring keys are in one page of one file."""
    near = nodes.repartition(F.floor(F.col("key") / FILE_PLACES)).sortWithinPartitions("key")
    return written(near, name, **{"parquet.page.row.count.limit": FILE_PLACES})


def tree(recs: DataFrame, name: str) -> list[DataFrame]:
    """Levels from the leaves to the root, each written below the shared folder."""
    levels = [_stored(leaves(recs), f"{name}-0")]
    low, high = levels[0].agg(F.min("key"), F.max("key")).first()
    while low is not None and not (low == high and len(levels) > 1):
        levels.append(_stored(parents(levels[-1]), f"{name}-{len(levels)}"))
        low, high = low // FANOUT, high // FANOUT
        # Floors of negative and other places meet at -1 and 0 at last.
        if low == -1 and high == 0:
            levels.append(_stored(_joined(levels[-1]), f"{name}-{len(levels)}"))
            break
    return levels


def _joined(nodes: DataFrame) -> DataFrame:
    """One root over the top of the negative and of the other places."""
    return parents(nodes.withColumn("key", F.col("key") + 1)).withColumn("key", F.lit(0).cast("bigint"))


def _below(level: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The rows of a level whose key div width is in nodes (a written table with key)."""
    low, high = nodes.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return level.where("false")
    part = F.floor((F.col("key") - low) * RANGES / (high - low + 1))
    bounds = nodes.groupBy(part.alias("p")).agg(F.min("key").alias("a"), F.max("key").alias("b")).select("a", "b").collect()
    inside = reduce(lambda x, y: x | y, [(F.col("key") >= r["a"] * width) & (F.col("key") < (r["b"] + 1) * width) for r in sorted(bounds)])
    wide = nodes.select(F.col("key").alias("up")).distinct()
    wide = F.broadcast(wide) if nodes.count() <= BROADCAST_ROWS else wide
    return level.where(inside).join(wide, F.floor(F.col("key") / width).cast("bigint") == F.col("up"), "left_semi")


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Places that differ: key, kind (changed, missing or extra in b), and n and bytes on either side.

    Trees of unequal height are compared from the level that both have.
    """
    top = min(len(a), len(b)) - 1
    differ: DataFrame | None = None
    for level in range(top, -1, -1):
        sides = a[level], b[level]
        if differ is not None:
            if not differ.limit(1).count():
                break  # Equal nodes stand for equal records, and nothing below them is read.
            # A root's children are few, and where negative places were joined their keys aren't below its own.
            sides = tuple(x[level] if level == len(x) - 2 else _below(x[level], differ, FANOUT) for x in (a, b))
        both = sides[0].withColumn("side", F.lit("a")).unionByName(sides[1].withColumn("side", F.lit("b")))
        of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
        node = both.groupBy("key").agg(*[of(c, s).alias(f"{c}_{s}") for c in ("digest", "n", "bytes") for s in "ab"])
        differ = written(node.where(~F.col("digest_a").eqNullSafe(F.col("digest_b"))), f"warc-differ-{level}")
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return differ.select("key", kind.alias("kind"), "n_a", "n_b", "bytes_a", "bytes_b", "digest_a", "digest_b")


def offsets(level0: DataFrame) -> DataFrame:
    """key, file and offset: where a place's records begin in their file."""
    file = F.floor(F.col("key") / FILE_PLACES).cast("bigint")
    before = Window.partitionBy("file").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = level0.select("key", file.alias("file"), "bytes")
    return rows.select("key", "file", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))


def located(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """audit() with the file and the offset in replica a of each differing place (in b for an extra one)."""
    differ = audit(a, b)
    file = F.floor(F.col("key") / FILE_PLACES).cast("bigint")
    files = written(differ.select(file.alias("key")).distinct(), "warc-files")

    def of(level0: DataFrame, suffix: str) -> DataFrame:
        return offsets(_below(level0, files, FILE_PLACES)).select("key", F.col("offset").alias(f"offset_{suffix}"))

    out = differ.join(of(a[0], "a"), "key", "left").join(of(b[0], "b"), "key", "left")
    return out.withColumn("file", file)


def damaged(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """A replica with known damage, for checks: some bodies lose their first character, some records are lost."""
    i = F.col(f"`{id_col}`")
    body = F.col(f"`{body_col}`")
    cut = F.when(i % 101 == 7, F.concat(F.lit("~"), F.substring(body, 2, F.length(body)))).otherwise(body)
    return pages.withColumn(body_col, cut).where(F.coalesce(i % 211 != 11, F.lit(True)))
