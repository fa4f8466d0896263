"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole text; each filter's highest response
in a chunk of CHUNK bytes is one feature of that chunk. Chunks overlap by half,
and the last one is what is left. A small layer turns a chunk's features into a
logit and the mean over chunks into one probability.

Training takes a bounded sample (MAX_TRAIN labelled rows, by the hash of their
id) on the driver, each text whole in every epoch; scoring covers every byte of
every text in batches of bounded size. Both have memory for SLICE bytes of filter
responses at a time.

Defined cases: a null or empty text scores as no chunk, by the bias alone;
repeated rows give a row each; null ids are scored and never train; a column named
score is replaced and others may have any names; without labels the network is
untrained; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerwatch.llm.common import bounded_batches

WIDTH = 6
FILTERS = 16
HIDDEN = 16
HALF = 256
CHUNK = 2 * HALF
#: Bytes that are in work at once.
SLICE = HALF * 256
#: Bound of the training sample, in labelled rows.
MAX_TRAIN = 2000


@dataclass
class Network:
    """conv: WIDTH x 256 x FILTERS; the rest maps a chunk's features to a logit."""

    conv: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.conv, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pairs(self) -> np.ndarray:
        """The filters' sums for each pair of neighbouring bytes: WIDTH / 2 x 65536 x FILTERS."""
        return np.stack([(self.conv[j][:, None, :] + self.conv[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])

    def logits(self, pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of chunks, from their pooled responses and sizes in bytes."""
        x = features(pooled + self.bias, sizes)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]


def features(pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum(pooled, 0), np.log(sizes / CHUNK)[:, None].astype(np.float32)], axis=1)


def initial(seed: int) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    return Network(f(WIDTH, 256, FILTERS, k=0.3), np.zeros(FILTERS, np.float32), f(FILTERS + 1, HIDDEN, k=0.3), np.zeros(HIDDEN, np.float32), f(HIDDEN, k=0.3), np.zeros(1, np.float32))


def padded(data: bytes) -> np.ndarray:
    """Bytes with zeros after them, so that a filter can start at each byte."""
    return np.frombuffer(data + bytes(WIDTH), dtype=np.uint8)


def half_maxima(tables: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The filters' maxima over each run of HALF starts; the last run may be shorter."""
    pair = raw[:-1].astype(np.int64) * 256 + raw[1:]
    out = []
    for at in range(0, n, SLICE):
        m = min(SLICE, n - at)
        got = np.take(tables[0], pair[at : at + m], axis=0)
        for j in range(1, len(tables)):
            got += np.take(tables[j], pair[at + 2 * j : at + 2 * j + m], axis=0)
        out.append(np.maximum.reduceat(got, np.arange(0, m, HALF), axis=0))
    return np.concatenate(out)


def chunk_maxima(halves: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks are two neighbouring halves; one half alone where there is no other."""
    if len(halves) == 1:
        return halves, np.array([n])
    sizes = np.full(len(halves) - 1, CHUNK)
    sizes[-1] = n - (len(halves) - 2) * HALF
    return np.maximum(halves[:-1], halves[1:]), sizes


def probability(net: Network, tables: np.ndarray, text: str | None) -> float:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return float(1 / (1 + np.exp(-net.b2[0])))
    pooled, sizes = chunk_maxima(half_maxima(tables, padded(data), len(data)), len(data))
    return float(1 / (1 + np.exp(-np.clip(net.logits(pooled, sizes).mean(dtype=np.float64), -30, 30))))


def fit(texts: list[str], labels: list[int], epochs: int = 5, seed: int = 7, rate: float = 0.01) -> Network:
    """Adam on the log loss, a few texts a step, each with all its chunks."""
    net, r = initial(seed), np.random.default_rng(seed)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    mean, square, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    batch = 16
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + rate * 0.05
        order = r.permutation(len(data))
        for first in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in net.params()]
            for i in order[first : first + batch]:
                _add_gradient(net, data[i], labels[i], grads)
            t += 1
            for k, p in enumerate(net.params()):
                g = grads[k] / batch
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                p -= step * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return net


def _responses(net: Network, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters' maxima over each run of HALF starts, and where they are."""
    best, where = [], []
    for at in range(0, n, SLICE):
        m = min(SLICE, n - at)
        got = net.conv[0][raw[at : at + m]]
        for j in range(1, WIDTH):
            got += net.conv[j][raw[at + j : at + j + m]]
        for h in range(0, m, HALF):
            top = got[h : h + HALF].argmax(axis=0)
            best.append(got[h + top, np.arange(FILTERS)])
            where.append(at + h + top)
    return np.stack(best), np.stack(where)


def _add_gradient(net: Network, data: bytes, label: int, grads: list[np.ndarray]) -> None:
    if not data:
        grads[5] += 1 / (1 + np.exp(-net.b2)) - label
        return
    raw = padded(data)
    halves, where = _responses(net, raw, len(data))
    pooled, sizes = chunk_maxima(halves, len(data))
    if len(halves) > 1:
        where = np.where(halves[:-1] >= halves[1:], where[:-1], where[1:])
    x = features(pooled + net.bias, sizes)
    h = np.maximum(x @ net.w1 + net.b1, 0)
    z = (h @ net.w2 + net.b2[0]).mean()
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(x)
    dh = np.where(h > 0, d * net.w2, 0).astype(np.float32)
    dx = (dh @ net.w1.T)[:, :FILTERS] * (x[:, :FILTERS] > 0)
    for j in range(WIDTH):
        np.add.at(grads[0][j], (raw[where + j], np.arange(FILTERS)), dx)
    grads[1] += dx.sum(axis=0)
    grads[2] += x.T @ dh
    grads[3] += dh.sum(axis=0)
    grads[4] += d * h.sum(axis=0)
    grads[5] += d * len(x)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves the remainder 1 by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from the labelled rows that aren't held out, at most MAX_TRAIN of them by the hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    # The ids are chosen before the texts are read.
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(MAX_TRAIN)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(known), "__id")
    rows = rows.orderBy(F.xxhash64("__id"), "__id", "__t").limit(MAX_TRAIN).select("__t", "__y").toPandas()
    if rows.empty:
        return initial(7)
    return fit([t or "" for t in rows["__t"]], [int(y) for y in rows["__y"]])


def score(df: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (one named score is replaced) and score."""
    bounded_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text_col, "score")]
    sent = df.sparkSession.sparkContext.broadcast(net.params())
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    chosen = df.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*sent.value)
        tables = own.pairs()
        for b in batches:
            scores = pa.array([probability(own, tables, t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], scores], names=[*keep, "score"])

    return chosen.mapInArrow(run, schema)
