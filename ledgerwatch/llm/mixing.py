"""Mixing sources to target weights, by blocks of tokens.

Each source's tokens are packed, in a pseudorandom order of its documents, into
blocks of fixed length. The mix is a list of slots, one block each, cut into
output shards. A shard's counts by source are a multinomial draw: each of its
slots draws its source by the target shares (alias method). A second step corrects
the draws to the targets: sources that drew more slots than their target asks for
give the surplus up, spread over all shards in proportion to their counts, to
those that drew fewer; sizes of shards stay as they are. The j-th slot of a source
in the mix takes block perm(j mod N) of its N blocks, perm being a pseudorandom
permutation that changes with each pass j div N. Slots and blocks join on (source,
block index).

Scale: packing needs running sums over a source that may hold a third of all
rows, so documents are dealt to hash buckets, as many for each source as its size
asks for, summed within buckets, and the buckets' sums are summed in a table
thousands of times smaller; sums over shards go the same way. Rows that are equal
in source, id and size are one row with a count until they are packed. What the
driver holds is a row for each source (MAX_SOURCES at most; more are refused).

Defined cases: a null text has the size 0 and takes nothing; a null source is a
source of its own, last in order; null and repeated ids keep their rows; texts of
any length are counted whole and span as many blocks as they fill. Draws depend on
the seed and the data alone, so reruns agree. A source that reaches the limit of
passes leaves its further slots empty. Other columns are left out, whatever their
names; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import words, written

#: Words in a block.
BLOCK = 64
#: Slots in an output shard.
SHARD_SLOTS = 4096
#: Distinct rows that a packing bucket is meant to have, and shards that are summed at once.
BUCKET_ROWS = 500
BUCKET_SHARDS = 4096
#: Sources are held on the driver; more are refused.
MAX_SOURCES = 10_000
#: Slots that a task is meant to draw or spread.
SLOTS_PER_TASK = 50_000
#: Equal rows that are put back at once.
EQUAL_ROWS = 10_000
#: The seed of all draws, where none is given.
SEED = 20240607
#: Rounds of the permutation.
ROUNDS = 24


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    rows: int
    target: float

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK)


def reshared(sizes: list[int], weights: list[float], max_passes: float) -> list[float]:
    """Targets by weight that sum to all sizes, none above max_passes times its size.

    What a stopped target can't take is shared by weight among the others, again
    and again until none is above.
    """
    total, free = float(sum(sizes)), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while free:
        share = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / share > max_passes * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weights[i] / share
            break
        for i in over:
            out[i] = max_passes * sizes[i]
            total -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sized(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, source_col: str = "source") -> DataFrame:
    """The kept columns, __src and size (words of the whole text)."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{source_col}`").cast("string").alias("__src"),
        F.size(words(F.col(f"`{text_col}`"))).cast("bigint").alias("size"),
    )


def sources_of(docs: DataFrame, cycle: tuple[float, ...], max_passes: float) -> list[Source]:
    """Sources by code point, null last, with their sizes and targets."""
    rows = docs.groupBy("__src").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("__src").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [int(r["n"]) for r in rows]
    targets = reshared(sizes, [cycle[i % len(cycle)] for i in range(len(rows))], max_passes)
    return [Source(r["__src"], n, r["rows"], t) for r, n, t in zip(rows, sizes, targets, strict=True)]


def _of(values: list, s: str) -> Column:
    """The value of a source by its number."""
    return F.get(F.lit(values), F.col(s).cast("int"))


def _before(df: DataFrame, s: str, bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the earlier rows of a source: by bucket first, then over the buckets' sums."""
    rows = df.withColumn("__b", bucket).withColumn("__v", value)
    sums = rows.groupBy(s, "__b").agg(F.sum("__v").alias("__n"))
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(s, "__b", F.coalesce(F.sum("__n").over(earlier([s], ["__b"])), F.lit(0)).alias("__off"))
    rows = rows.withColumn("__in", F.coalesce(F.sum("__v").over(earlier([s, "__b"], order)), F.lit(0)))
    return rows.join(sums, [s, "__b"]).withColumn(out, F.col("__off") + F.col("__in")).drop("__b", "__v", "__off", "__in")


def packed(docs: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """Adds __at, the place of each document's first word in its source's sequence; unique where size > 0."""
    equal = docs.groupBy("__s", "__id", "size").agg(F.count(F.lit(1)).alias("__m"))
    equal = equal.withColumn("__key", F.xxhash64(F.lit(seed).cast("bigint"), "__id", "size"))
    buckets = [max(1, -(-s.rows // BUCKET_ROWS)) for s in sources]
    placed = _before(equal, "__s", F.pmod("__key", _of(buckets, "__s").cast("bigint")), ["__key", "__id", "size"], F.col("size") * F.col("__m"), "__at")
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__m") - 1) / EQUAL_ROWS).cast("bigint")))
    placed = placed.withColumn("__part", part).withColumn("__low", F.col("__part") * EQUAL_ROWS)
    one = F.explode(F.sequence("__low", F.least(F.col("__low") + EQUAL_ROWS, F.col("__m")) - 1))
    placed = placed.withColumn("__i", one).withColumn("__at", F.col("__at") + F.col("__i") * F.col("size"))
    return placed.select("__s", "__id", "size", "__at")


def permuted(x: Column, n: Column, salt: list[Column]) -> Column:
    """A pseudorandom permutation of 0..n-1 by the swap-or-not construction: each round mirrors x or leaves it."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*salt, r.cast("bigint")), n) - x, n)
        swap = F.xxhash64(*salt, r.cast("bigint"), F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def alias_table(shares: list[float]) -> tuple[list[float], list[int]]:
    """For each column, the part of it that draws the column itself, and what the rest draws."""
    n = len(shares)
    part, other = [x * n for x in shares], list(range(n))
    low, high = [i for i in range(n) if part[i] < 1], [i for i in range(n) if part[i] >= 1]
    while low and high:
        i, j = low.pop(), high[-1]
        other[i] = j
        part[j] -= 1 - part[i]
        if part[j] < 1:
            low.append(high.pop())
    for i in low + high:
        part[i] = 1.0
    return part, other


def apportioned(sources: list[Source]) -> list[int]:
    """Slots by source: the target in blocks, rounded to a common sum; the largest remainders go up, the first of equal ones."""
    asked = [s.target / BLOCK for s in sources]
    out = [int(x) for x in asked]
    order = sorted(range(len(asked)), key=lambda i: (out[i] - asked[i], i))
    for i in order[: int(round(sum(asked))) - sum(out)]:
        out[i] += 1
    if sum(s.target for s in sources) and not sum(out):
        out[order[0]] = 1
    return out


def drawn(spark, sources: list[Source], seed: int) -> DataFrame:
    """Rows (shard, s, n): how many slots of an output shard draw each source."""
    slots, total = sum(apportioned(sources)), sum(s.target for s in sources)
    part, other = alias_table([s.target / total if total else 0.0 for s in sources])
    shards = -(-slots // SHARD_SLOTS)
    df = spark.range(0, shards, 1, max(1, slots // SLOTS_PER_TASK)).select(F.col("id").alias("shard"))
    df = df.select("shard", F.explode(F.sequence(F.col("shard") * SHARD_SLOTS, F.least((F.col("shard") + 1) * SHARD_SLOTS, F.lit(slots)) - 1)).alias("slot"))
    column = F.pmod(F.xxhash64(F.lit(seed).cast("bigint"), "slot"), F.lit(len(sources))).cast("int")
    sure = F.pmod(F.xxhash64(F.lit(seed + 1).cast("bigint"), "slot"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    df = df.select("shard", column.alias("c"), sure.alias("u"))
    s = F.when(F.col("u") < _of(part, "c"), F.col("c")).otherwise(_of(other, "c"))
    return df.groupBy("shard", s.alias("s")).agg(F.count(F.lit(1)).alias("n"))


def corrected(counts: DataFrame, wanted: list[int]) -> DataFrame:
    """counts with the surplus of some sources handed on to others, so that sums over shards are as wanted."""
    had = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    surplus = [had.get(i, 0) - w for i, w in enumerate(wanted)]
    if not any(surplus):
        return counts
    given, taken = [], []  # places in one queue of handed on slots
    at = to = 0
    for i, x in enumerate(surplus):
        given.append(at)
        if x < 0:
            taken.append((i, to, to - x))
            to -= x
        at += max(x, 0)
    over = counts.withColumn("more", _of([max(x, 0) for x in surplus], "s").cast("bigint"))
    over = _before(over, "s", F.floor(F.col("shard") / BUCKET_SHARDS), ["shard"], F.col("n"), "c0")
    total, first = _of([max(1, had.get(i, 0)) for i in range(len(wanted))], "s").cast("bigint"), _of(given, "s").cast("bigint")
    over = over.withColumns({"total": total, "first": first})
    over = over.withColumns({"a": F.expr("first + c0 * more DIV total"), "b": F.expr("first + (c0 + n) * more DIV total")})
    kept = over.select("shard", "s", (F.col("n") - (F.col("b") - F.col("a"))).alias("n"))
    takers = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for i, x, y in taken])
    moved = over.where("b > a").select("shard", "a", "b", F.explode(F.filter(takers, lambda t: (t["x"] < F.col("b")) & (t["y"] > F.col("a")))).alias("t"))
    moved = moved.select("shard", F.col("t.s").alias("s"), (F.least("b", "t.y") - F.greatest("a", "t.x")).alias("n"))
    return kept.unionByName(moved).groupBy("shard", "s").agg(F.sum("n").alias("n"))


def slots_of(counts: DataFrame, sources: list[Source], seed: int, max_passes: int) -> DataFrame:
    """Rows (shard, s, block), one for each slot of the mix that is within the limit of passes."""
    placed = _before(counts.where("n > 0"), "s", F.floor(F.col("shard") / BUCKET_SHARDS), ["shard"], F.col("n"), "j0")
    # Shards are dealt anew: a source's slots must not stay in the task that summed its counts.
    placed = placed.repartition(max(1, sum(x.blocks for x in sources) // SLOTS_PER_TASK), "s", "shard")
    many = _of([s.blocks for s in sources], "s").cast("bigint")
    j = placed.select("shard", "s", many.alias("blocks"), F.explode(F.sequence(F.col("j0"), F.col("j0") + F.col("n") - 1)).alias("j"))
    j = j.where((F.col("blocks") > 0) & (F.col("j") < F.col("blocks") * max_passes))
    turn = F.floor(F.col("j") / F.col("blocks")).cast("bigint")
    salt = [F.lit(seed).cast("bigint"), F.col("s").cast("bigint"), turn]
    return j.select("shard", "s", permuted(F.pmod("j", "blocks"), F.col("blocks"), salt).alias("block"))


def mix(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
    cycle: tuple[float, ...] = (5, 2, 1), max_passes: int = 3, seed: int = SEED,
) -> DataFrame:
    """Id, size, source_size, target and taken (words that the mix takes, repeats counted), a row for each row of df."""
    spark = df.sparkSession
    docs = sized(df, text_col, [id_col], source_col).withColumnRenamed(id_col, "__id")
    docs = written(docs, "mix-sizes")
    sources = sources_of(docs, cycle, max_passes)
    if not sources:
        return docs.select(
            F.col("__id").alias(id_col), "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("taken")
        )
    names = F.lit([s.name for s in sources if s.name is not None] or [""])
    at = F.when(F.col("__src").isNull(), F.lit(len(sources) - 1)).otherwise(F.array_position(names, F.col("__src")).cast("int") - 1)
    docs = docs.withColumn("__s", at).drop("__src")
    placed = packed(docs, sources, seed)
    counts = corrected(written(drawn(spark, sources, seed), "mix-counts"), apportioned(sources))
    uses = slots_of(counts, sources, seed, max_passes).groupBy("s", "block").agg(F.count(F.lit(1)).alias("uses"))
    first, last = F.floor(F.col("__at") / BLOCK), F.floor((F.col("__at") + F.col("size") - 1) / BLOCK)
    cut = placed.where("size > 0").select("__s", "__at", "size", F.explode(F.sequence(first, last)).alias("block"))
    end = F.least(F.col("__at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    cut = cut.withColumn("words", end - F.greatest(F.col("__at"), F.col("block") * BLOCK))
    uses = uses.withColumnsRenamed({"s": "__s"})
    # Spark takes the slots for as few as the shards they come from, and would broadcast them.
    got = cut.join(uses.hint("merge"), ["__s", "block"]).groupBy("__s", "__at").agg(F.sum(F.col("uses") * F.col("words")).alias("taken"))
    # Documents of size 0 share places with others, so they join nothing.
    key = F.when(F.col("size") > 0, F.col("__at"))
    got = got.select(F.col("__s").alias("__gs"), F.col("__at").alias("__gat"), "taken")
    out = placed.join(got, (F.col("__s") == F.col("__gs")) & (key == F.col("__gat")), "left")
    pick = lambda values: _of(values, "__s")
    return out.select(
        F.col("__id").alias(id_col), "size",
        pick([s.size for s in sources]).cast("bigint").alias("source_size"),
        pick([float(s.target) for s in sources]).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )
