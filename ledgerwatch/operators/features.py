"""Features of transactions for anomaly scores, and an isolation forest over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.operators import tuning
from ledgerwatch.sources.shared import ready_to_checkpoint

NAMES = ("amount_zscore", "velocity_1h", "velocity_24h", "counterparty_diversity", "country_diversity", "time_of_day_sin", "time_of_day_cos")


def _zscore(mean: Column, deviation: Column) -> Column:
    return (F.col("amount") - mean) / F.greatest(F.coalesce(deviation, F.lit(0.0)), F.lit(1e-9))


def _clock(of) -> Column:
    return of(2 * F.pi() * (F.hour("ts") + F.minute("ts") / 60) / 24)


def _velocity(hours: int) -> Column:
    w = Window.partitionBy("account_id").orderBy("__us").rangeBetween(-hours * 3_600_000_000, 0)
    return (F.count(F.lit(1)).over(w) - 1).cast("double")


def batch_features(txns: DataFrame) -> DataFrame:
    """transaction_id, account_id and the seven features; account statistics over the whole history.

    The statistics are one aggregate joined back; the velocities share one window.
    """
    stats = txns.groupBy("account_id").agg(
        F.avg("amount").alias("__mean"), F.stddev_samp("amount").alias("__sd"),
        F.count_distinct(F.when(F.col("counterparty") != "", F.col("counterparty"))).alias("__cp"),
        F.count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("__co"),
    )
    rows = txns.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumns({"velocity_1h": _velocity(1), "velocity_24h": _velocity(24)}).join(stats, "account_id")
    return _selected(rows, F.col("__mean"), F.col("__sd"), F.col("__cp"), F.col("__co"))


def online_features(txns: DataFrame) -> DataFrame:
    """The same from the history up to each transaction, its own time included.

    A value counts where an account first has it, so distinct ones are sums and no frame holds a set.
    Rows are dealt by account once; all windows keep to that.
    """
    w = Window.partitionBy("account_id").orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
    rows = txns.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("account_id")
    new = lambda c: F.when(F.col(c) != "", (F.row_number().over(Window.partitionBy("account_id", c).orderBy("__us", "id")) == 1).cast("bigint"))
    rows = rows.withColumns({"__cp1": new("counterparty"), "__co1": new("country")})
    rows = rows.withColumns({
        "velocity_1h": _velocity(1), "velocity_24h": _velocity(24), "__mean": F.avg("amount").over(w), "__sd": F.stddev_samp("amount").over(w),
        "__cp": F.coalesce(F.sum("__cp1").over(w), F.lit(0)), "__co": F.coalesce(F.sum("__co1").over(w), F.lit(0)),
    })
    return _selected(rows, F.col("__mean"), F.col("__sd"), F.col("__cp"), F.col("__co"))


def _selected(rows: DataFrame, mean: Column, sd: Column, cp: Column, co: Column) -> DataFrame:
    return rows.select(
        F.col("id").alias("transaction_id"), "account_id", _zscore(mean, sd).alias("amount_zscore"), "velocity_1h", "velocity_24h",
        cp.cast("double").alias("counterparty_diversity"), co.cast("double").alias("country_diversity"),
        _clock(F.sin).alias("time_of_day_sin"), _clock(F.cos).alias("time_of_day_cos"),
    )


def _average_path(n: float) -> float:
    """Mean path of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees of random splits over a bounded sample; short paths mean anomalies."""

    def __init__(self, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42):
        self.trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed
        self.nodes: list[np.ndarray] = []
        self.offset = -0.5

    def fit(self, x: np.ndarray) -> IsolationForest:
        """x is a sample already; decisions are shifted so that its contamination share is below 0."""
        rng = np.random.default_rng(self.seed)
        self.n = min(self.sample, len(x))
        depth = int(np.ceil(np.log2(max(self.n, 2))))
        self.nodes = [self._tree(x[rng.choice(len(x), self.n, replace=False)], depth, rng) for _ in range(self.trees)]
        self.offset = float(np.quantile(self.score(x), self.contamination))
        return self

    def _tree(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
        """Rows (feature or -1, cut or path length, left, right)."""
        rows: list[list[float]] = []

        def grow(part: np.ndarray, level: int) -> int:
            at = len(rows)
            rows.append([-1, level + _average_path(len(part)), -1, -1])
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
            if level < depth and len(part) > 1 and len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                low = part[:, f] < cut
                rows[at][:2] = [f, cut]
                rows[at][2], rows[at][3] = grow(part[low], level + 1), grow(part[~low], level + 1)
            return at

        grow(x, 0)
        return np.array(rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Minus two to the power of the mean path over the expected one: from -1 (anomalous) to 0."""
        total = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 1]
        return -(2.0 ** (-(total / len(self.nodes)) / max(_average_path(self.n), 1e-9)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) - self.offset

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 by the logistic function; higher is more anomalous."""
        return np.clip(1 / (1 + np.exp(5 * self.decision(x))), 0.0, 1.0)

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees, "sample": self.sample, "contamination": self.contamination, "seed": self.seed, "n": self.n, "offset": self.offset, "nodes": [t.tolist() for t in self.nodes]})

    @classmethod
    def from_json(cls, text: str) -> IsolationForest:
        d = json.loads(text)
        out = cls(d["trees"], d["sample"], d["contamination"], d["seed"])
        out.n, out.offset, out.nodes = d["n"], d["offset"], [np.array(t) for t in d["nodes"]]
        return out


#: Rows from which trees draw theirs, those of the least hash of their id.
TRAIN_ROWS = 20_000


def train_forest(features: DataFrame, **options) -> tuple[IsolationForest, str]:
    """A forest whose trees draw from at most TRAIN_ROWS rows, its offset over all rows, and the hash of the rows drawn from."""
    rows = features.orderBy(F.xxhash64("transaction_id"), "transaction_id").limit(TRAIN_ROWS).toPandas()
    x = rows[list(NAMES)].to_numpy(dtype="float64")
    forest = IsolationForest(**options).fit(x)
    ready_to_checkpoint(features.sparkSession)
    scores = _by_forest(features, forest, "score").select("score").checkpoint()
    forest.offset = _quantile(scores, "score", forest.contamination)
    return forest, hashlib.sha256(x.tobytes()).hexdigest()


def _quantile(values: DataFrame, col: str, p: float) -> float:
    """Exact, between the two nearest elements in proportion, as numpy's."""
    n = values.count()
    low = int(p * (n - 1))
    at = lambda k: tuning.percentile(values, col, (min(k, n - 1) + 0.5) / n).first()["value"]
    a, b = at(low), at(low + 1)
    return a + (b - a) * (p * (n - 1) - low)


def _by_forest(features: DataFrame, forest: IsolationForest, method: str) -> DataFrame:
    """transaction_id, account_id and what the forest's method gives, in a column of its name."""
    sent = features.sparkSession.sparkContext.broadcast(forest.to_json())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = IsolationForest.from_json(sent.value)
        for pdf in batches:
            if len(pdf):
                values = getattr(model, method)(pdf[list(NAMES)].to_numpy(dtype="float64"))
                yield pdf[["transaction_id", "account_id"]].assign(**{method: values})

    return features.mapInPandas(run, f"transaction_id long, account_id long, {method} double")


def anomaly_scores(features: DataFrame, forest: IsolationForest) -> DataFrame:
    """transaction_id, account_id and anomaly_score."""
    return _by_forest(features, forest, "anomaly").withColumnRenamed("anomaly", "anomaly_score")


def anomaly_hits(scores: DataFrame, threshold: float, severity: str = "medium", delta: float = 20.0) -> DataFrame:
    """transaction_id and anomaly, the hit of each score from the threshold on."""
    h = F.struct(
        F.lit("MLAnomaly").alias("rule_id"), F.lit(severity).alias("severity"), F.format_string("Anomaly score %.3f", F.col("anomaly_score")).alias("reason"),
        F.to_json(F.struct("anomaly_score", F.lit(threshold).alias("threshold"))).alias("evidence"), F.lit(float(delta)).alias("score_delta"),
    )
    return scores.where(F.col("anomaly_score") >= threshold).select("transaction_id", F.array(h).alias("anomaly"))
