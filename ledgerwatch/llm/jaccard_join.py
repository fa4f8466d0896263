"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections.

Each text becomes the sorted set of the hashes of its word n-grams. Two texts
link when their sets' Jaccard similarity reaches num/den; the result has each
text's connected component.

Candidates lose no link. Sizes of linked sets differ by the factor num/den at
most, so sizes fall into bands and only equal or neighbouring bands meet. In a
band, linked sets differ in at most H elements; the hash range is cut into m > H
parts, so that some part is equal in both. The content hashes of the parts
are the keys by which sets meet. (Empty parts are no keys, unless a set has so
many that the count argument would fail without them.)

A key's sets would be a group of unbounded size, so a group first meets in its
least member alone, by aggregation: each set is compared with the leader with
which it shares most keys. Verified links give components. Only then the groups
that still hold two components or more are dealt into tiles of TILE rows, in
which sets of different components are compared by bitmap: a set's bit string
has a bit flipped for each element, so unequal bits bound the elements in which
two sets differ from below, and the overlap from above. What passes is verified by the
exact intersection of the sorted arrays. In the first round a tile passes on no
more pairs than join its components; from the second on it passes on all that
are left, in portions that grow until no tile holds back any.

Copies of one set are one class and cost one row in these steps. Hashes of
n-grams and sets have 64 bits.

Defined cases: a null or empty text has no set, links with nothing and is its
own component; with fewer words than n, the whole sequence is the one element;
null and repeated ids keep their rows, two texts of one id are judged apart, and a
component's id is its least id that isn't null. Ids may have any type that has an
order. Other columns of df are left out, whatever their names. An empty table
gives no rows. A text is one value and its set one array, so memory is that of the
longest texts of a batch, which is bounded by bytes (common.BATCH_BYTES).

A key that n classes share, none of them linked, costs n^2 / TILE rows: that all
of them meet is what makes the join exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ledgerwatch.llm.common import bounded_batches, written

#: Sizes of a band reach from its least to that times this.
BAND_RATIO = 1.4
#: Rows of a tile.
TILE = 2048
#: Sets wanted for verification are sent to all executors up to this number, else joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Cached word hashes in a worker.
MAX_CACHED = 300_000
#: Rows of tiles, copied ones included, that a task is meant to have, and pairs that it remembers having passed on.
TASK_ROWS = 20_000
MAX_SEEN = 1_000_000
#: Pairs that a tile passes on for each two components, in the first round that isn't a forest; 16 times as many in each next.
FIRST_PORTION = 64

_U = np.uint64
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"multiplier {i}") | 1 for i in range(64)], dtype=_U)


@dataclass(frozen=True)
class Measure:
    """n-grams of n words; linked when den * intersection >= num * union."""

    n: int
    num: int
    den: int

    def differ(self, a, b):
        """The most elements in which linked sets of a and b elements may differ."""
        least = -((-self.num * (a + b)) // (self.num + self.den))
        return a + b - 2 * least


@dataclass(frozen=True)
class Band:
    index: int
    low: int
    high: int
    parts: int
    differ: int


@cache
def bands(measure: Measure, up_to: int) -> tuple[Band, ...]:
    """The bands of all sizes from 1 to up_to at least."""
    out, low = [], 1
    while low <= up_to:
        high = max(low, int(low * BAND_RATIO))
        larger = high * measure.den // measure.num
        differ = (high + larger) * (measure.den - measure.num) // (measure.den + measure.num)
        parts = differ + 1
        # Room for the empty parts that sets of the least size are likely to have.
        while differ and parts < 3 * differ + 8:
            empty = parts * math.exp(-low / parts)
            if parts - differ > empty + 4 * math.sqrt(empty) + 1:
                break
            parts += 1 + parts // 64
        out.append(Band(len(out), low, high, parts, differ))
        low = high + 1
    return tuple(out)


def _bands_for(measure: Measure, n: int) -> tuple[Band, ...]:
    return bands(measure, 1 << max(10, n.bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, _U)
        # bytes.lower() changes A-Z only, and bytes.split() splits at space and tab to carriage return.
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, _U)
        known = self.known
        if len(known) > MAX_CACHED:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            total = h[: len(h) - n + 1] * _MULTIPLIERS[0] + _U(n)
            for k in range(1, n):
                total += h[k : len(h) - n + 1 + k] * _MULTIPLIERS[k]
            return np.unique(mixed(total))


def set_hash(s: np.ndarray) -> int:
    """64 bits of a whole set, as a signed number."""
    with np.errstate(over="ignore"):
        total = mixed(s ^ _MULTIPLIERS[40]).sum(dtype=_U) + _U(len(s))
    return int(mixed(np.array([total], _U)).view(np.int64)[0])


def keys_of(s: np.ndarray, measure: Measure) -> np.ndarray:
    """The content hashes of a set's parts, in its own band and, where partners may be there, the lower one."""
    n, table = len(s), _bands_for(measure, len(s))
    own = next(b for b in table if b.high >= n)
    chosen = [own]
    if own.index and -(-n * measure.num // measure.den) <= table[own.index - 1].high:
        chosen.append(table[own.index - 1])
    content, out = mixed(s ^ _MULTIPLIERS[41]), []
    with np.errstate(over="ignore"):
        for b in chosen:
            if not b.differ:
                continue  # only equal sets link here, and those are one class
            part = ((s >> _U(32)) * _U(b.parts)) >> _U(32)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
            where, sums = part[starts], np.add.reduceat(content, starts)
            if b.parts - len(where) >= b.parts - b.differ:
                empty = np.setdiff1d(np.arange(b.parts, dtype=_U), where)
                where, sums = np.concatenate([where, empty]), np.concatenate([sums, np.zeros(len(empty), _U)])
            out.append(mixed(sums + mixed(where * _MULTIPLIERS[42] + _U(b.index))))
    return np.concatenate(out) if out else np.empty(0, _U)


def bits_of(s: np.ndarray) -> bytes:
    """A bit string of at least twice as many bits as elements (a power of two), flipped at each element's hash."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    flips = np.bincount((mixed(s ^ _MULTIPLIERS[43]) & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Bit strings as rows of 64-bit words, halved by exclusive or to the least width among them."""
    least = min(map(len, bits))
    out = np.empty((len(bits), least // 8), _U)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, _U).reshape(-1, least // 8)
        out[i] = row[0] if len(row) == 1 else np.bitwise_xor.reduce(row, axis=0)
    return out


def signed(df: DataFrame, measure: Measure, text_col: str, id_col: str) -> DataFrame:
    """id, t (the text's hash), n, c (class), keys and bits of each text."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    made = [StructField("n", LongType()), StructField("c", LongType()), StructField("keys", ArrayType(LongType())), StructField("bits", BinaryType())]
    schema = StructType([*rows.schema.fields[:2], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(measure.n)
        for b in batches:
            sizes, classes, keys, bits = [], [], [], []
            for t in b.column(2):
                s = shingle(t.as_py())
                sizes.append(len(s))
                classes.append(set_hash(s) if len(s) else 0)
                keys.append(keys_of(s, measure).view(np.int64) if len(s) else np.empty(0, np.int64))
                bits.append(bits_of(s) if len(s) else b"")
            columns = [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists(keys), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow column of 64-bit arrays, of none of them too."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, measure: Measure, text_col: str, id_col: str) -> DataFrame:
    """The pairs (a, b) of classes that link, by exact intersection of their sets, made anew from the texts."""
    # One row of each class is enough; its id and the hash of its text lead to its text.
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = written(classes.join(wanted, "c", "left_semi").select("c", "id", "t"), "jaccard-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    side = wanted.select("c", F.col("id").alias("wid"), F.col("t").alias("wt"))
    rows = rows.join(F.broadcast(side) if few else side, F.col("id").eqNullSafe(F.col("wid")) & (F.col("t") == F.col("wt"))).select("c", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(measure.n)
        for b in batches:
            right, made = [], []
            for c, t in zip(b.column(0), b.column(1), strict=True):
                s = shingle(t.as_py())
                # Hashes of texts may be equal too.
                if len(s) and set_hash(s) == c.as_py():
                    right.append(c.as_py())
                    made.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.int64()), lists(made)], names=["c", "s"])

    arrays = rows.mapInArrow(sets, "c long, s array<long>").dropDuplicates(["c"])
    arrays = written(arrays, "jaccard-sets")
    both = pairs.join(arrays.withColumnsRenamed({"c": "a", "s": "sa"}), "a").join(arrays.withColumnsRenamed({"c": "b", "s": "sb"}), "b")

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                x, y = np.asarray(x, np.int64).view(_U), np.asarray(y, np.int64).view(_U)
                both_in = overlap(x, y)
                good.append(measure.den * both_in >= measure.num * (len(x) + len(y) - both_in))
            yield pdf.loc[good, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """c and label (the least class of its component) for each class in a link; links is a written table.

    Labels fall to the least one among neighbours, then to their label's label, until none changes.
    """
    links = links.where("a <> b")
    edges = written(links.union(links.select("b", "a")).distinct(), "jaccard-edges")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    labels = written(least.select(F.col("a").alias("c"), F.least("a", "m").alias("label")), "jaccard-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["c"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["c"] == near["a"]).select("c", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("c").alias("u"), F.col("label").alias("ul"))
        jumped = lower.join(up, lower["label"] == up["u"], "left").select("c", "was", F.least("label", F.coalesce("ul", "label")).alias("label"))
        after = written(jumped, "jaccard-labels")
        if not after.where("was <> label").limit(1).count():
            return after.select("c", "label")
        labels = after.select("c", "label")


def _label(rows: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the label of a class column, the class itself where it has no link."""
    side = labels.select(F.col("c").alias("__c"), F.col("label").alias("__l"))
    return rows.join(side, rows[col] == side["__c"], "left").withColumn(out, F.coalesce("__l", col)).drop("__c", "__l")


def _may_link(tile: pd.DataFrame, measure: Measure, portion: int) -> list[tuple[int | None, int | None, bool]]:
    """Pairs of a tile's sets with different labels that may link; rows that aren't main meet all others.

    With portion 0, a forest of such pairs: one that joins what others have joined
    already is left out. Else at most portion pairs for each two labels, those of
    the fewest unequal bits. A row (None, None, True) tells that there may be more.
    """
    c, first = np.unique(tile["c"].to_numpy(np.int64), return_index=True)
    size, label = tile["n"].to_numpy(np.int64)[first], tile["label"].to_numpy(np.int64)[first].copy()
    main = tile["main"].to_numpy(bool)[first]
    words = folded(list(tile["bits"].to_numpy()[first]))
    out: list[tuple[int | None, int | None, bool]] = []
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i in np.flatnonzero(~main):
        others = np.flatnonzero((label != label[i]) & (main | (np.arange(len(c)) > i)))
        if not len(others):
            continue
        unequal = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
        near = unequal <= measure.differ(size[others], size[i])
        others, unequal = others[near], unequal[near]
        if portion:
            for j, d in zip(others, unequal, strict=True):
                two = (min(label[i], label[j]), max(label[i], label[j]))
                best.setdefault(two, []).append((int(d), int(min(c[i], c[j])), int(max(c[i], c[j]))))
            continue
        order = np.argsort(unequal, kind="stable")
        joined, one = np.unique(label[others[order]], return_index=True)
        out += [(int(min(c[i], c[j])), int(max(c[i], c[j])), False) for j in others[order[one]]]
        label[np.isin(label, joined)] = label[i]
    out += [(a, b, False) for found in best.values() for _, a, b in sorted(found)[:portion]]
    more = bool(out) if not portion else any(len(found) > portion for found in best.values())
    return [*out, (None, None, True)] if more else out


def _tiled(rows: DataFrame, measure: Measure, portion: int) -> DataFrame:
    """What _may_link gives for each tile of rows (about, salt, key, tile, main, c, label, n, bits).

    Two sets meet in many tiles. Tiles about one component go to one task, or to
    few by the salt, which passes on a pair once.
    """
    dealt = rows.repartition("about", "salt").sortWithinPartitions("about", "salt", "key", "tile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        seen: set[tuple[int | None, int | None]] = set()

        def fresh(a: int | None, b: int | None) -> bool:
            if (a, b) in seen:
                return False
            if len(seen) >= MAX_SEEN:
                seen.clear()
            seen.add((a, b))
            return True

        def done(part: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
            out = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for x in _may_link(part.iloc[a:b], measure, portion)]
            out = [x for x in out if fresh(x[0], x[1])]
            return pd.DataFrame(out, columns=["a", "b", "more"]).astype({"a": "Int64", "b": "Int64"})

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key, tile = pdf["key"].to_numpy(), pdf["tile"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1])
            # The last tile may go on in the next batch.
            held = pdf.iloc[cuts[-1] :]
            yield done(pdf, cuts)
        if held is not None:
            yield done(held, np.array([0, len(held)]))

    return dealt.select("key", "tile", "main", "c", "label", "n", "bits").mapInPandas(run, "a long, b long, more boolean")


def join(
    df: DataFrame, measure: Measure, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """id_col, n_shingles and component_id, a row for each row of df."""
    bounded_batches(df.sparkSession)
    docs = written(signed(df, measure, text_col, id_col), "jaccard-signed")
    some = docs.where("n > 0")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("one")
    classes = some.groupBy("c").agg(one, F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = written(classes.select("c", "one.id", "one.t", "n", "bits"), "jaccard-classes")
    met = some.select("c", F.explode("keys").alias("key"))
    # Groups of one class go at once: most keys, and all that only copies share.
    groups = written(met.groupBy("key").agg(F.min("c").alias("lead"), F.max("c").alias("last")).where("lead < last").select("key", "lead"), "jaccard-groups")
    grouped = written(met.join(groups, "key").select("key", "c", "lead").distinct(), "jaccard-grouped")
    # A set's leader is the one of most of its groups.
    votes = grouped.where("c <> lead").groupBy("c", "lead").agg(F.count(F.lit(1)).alias("v"))
    first = votes.groupBy("c").agg(F.max_by("lead", F.struct("v", -F.col("lead"))).alias("lead")).select(F.col("c").alias("a"), F.col("lead").alias("b"))
    links = written(verified(_bounded(first, classes, measure), classes, df, measure, text_col, id_col), "jaccard-links")
    labels = components(links)
    portion, done = 0, False
    while not done:
        rows = _label(grouped, labels, "c", "label")
        sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
        sizes = sizes.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("n_all"), F.count(F.lit(1)).alias("n_labels"))
        left = sizes.where("n_labels > 1").withColumn("tiles", F.ceil(F.col("n_all") / TILE).cast("int"))
        dealt_rows = F.col("n_main") + (F.col("n_all") - F.col("n_main")) * F.col("tiles")
        loads = left.groupBy("main").agg(F.ceil(F.sum(dealt_rows) / TASK_ROWS).alias("spread"))
        left = left.select("key", "main", "tiles").join(loads, "main")
        rows = rows.join(left, "key")
        is_main = F.col("label") == F.col("main")
        dealt = F.when(is_main, F.array(F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
        rows = rows.select("key", "c", "label", is_main.alias("main"), F.col("main").alias("about"), "spread", F.explode(dealt).alias("tile"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "tile"), F.col("spread"))).drop("spread")
        rows = rows.join(classes.select("c", "n", "bits"), "c")
        tiled = written(_tiled(rows, measure, portion), "jaccard-tiled")
        pairs = tiled.where("a is not null").select("a", "b").distinct()
        new = written(verified(pairs, classes, df, measure, text_col, id_col), "jaccard-links")
        done = not tiled.where("more").limit(1).count()
        portion = 16 * portion or FIRST_PORTION
        if new.limit(1).count():
            links = written(links.union(new).distinct(), "jaccard-links")
            labels = components(links)
    of_class = _label(classes.select("c", "id"), labels, "c", "label")
    least = of_class.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(least, "label").select("c", "component_id")
    out = docs.select("id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(of_class, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _bounded(pairs: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) whose bitmaps and sizes leave a link possible."""
    small = classes.select("c", "n", "bits")
    rows = pairs.join(small.withColumnsRenamed({"c": "a", "n": "na", "bits": "ba"}), "a").join(small.withColumnsRenamed({"c": "b", "n": "nb", "bits": "bb"}), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = []
            for x, y, n, k in zip(pdf["ba"], pdf["bb"], pdf["na"], pdf["nb"], strict=True):
                w = folded([x, y])
                good.append(int(np.bitwise_count(w[0] ^ w[1]).sum()) <= measure.differ(int(n), int(k)))
            yield pdf.loc[good, ["a", "b"]]

    return rows.select("a", "b", "ba", "bb", "na", "nb").mapInPandas(run, "a long, b long")
