"""Thresholds from data."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.sources.shared import ranged


def percentile(values: DataFrame, col: str, p: float) -> DataFrame:
    """One row, value: the element at floor(p * n), at most the last, in order; none for an empty table.

    Distinct values with their counts are added up over ranges, so no task sorts all rows.
    """
    counts = values.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    parts = ranged(counts, "value", "part")
    from pyspark.sql.window import Window

    back = Window.unboundedPreceding
    inside = F.sum("c").over(Window.partitionBy("part").orderBy("value").rowsBetween(back, 0))
    sums = parts.groupBy("part").agg(F.sum("c").alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(back, -1)), F.lit(0)).alias("b"))
    total = sums.agg(F.sum("s").alias("n"))
    placed = parts.withColumn("i", inside).join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    k = F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    last = F.col("b") + F.col("i")
    return placed.where((last > k) & (last - F.col("c") <= k)).select("value")


def rounded_threshold(p: Column, step: int) -> Column:
    """To the nearest step, half to even, 1000 at least; 1000 where there is no data."""
    return F.greatest(F.lit(1000.0), F.coalesce(F.bround(p / step) * step, F.lit(1000.0)))


def amount_thresholds(txns: DataFrame) -> DataFrame:
    """high_value from the 99th and structuring from the 95th percentile of absolute amounts."""
    a = txns.select(F.abs("amount").alias("a"))
    one = txns.sparkSession.range(1)
    high = percentile(a, "a", 0.99).agg(F.max("value").alias("p99"))
    mid = percentile(a, "a", 0.95).agg(F.max("value").alias("p95"))
    both = one.crossJoin(high).crossJoin(mid)
    return both.select(rounded_threshold(F.col("p99"), 1000).alias("high_value"), rounded_threshold(F.col("p95"), 500).alias("structuring"))


def bucket_peaks(txns: DataFrame, minutes: int = 15) -> DataFrame:
    """account_id and peak: its most transactions in a bucket of so many minutes of the epoch."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes))
    return txns.groupBy("account_id", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy("account_id").agg(F.max("n").alias("peak"))


def velocity_threshold(txns: DataFrame) -> DataFrame:
    """min_transactions: one above the 90th percentile of the accounts' peaks, 3 at least."""
    p = percentile(bucket_peaks(txns), "peak", 0.90).agg(F.max("value").alias("p90"))
    return p.select(F.greatest(F.lit(3), F.coalesce(F.col("p90"), F.lit(2)) + 1).cast("bigint").alias("min_transactions"))


def write_tuned(path: str, amounts: dict, velocity: dict) -> None:
    """A configuration layer with the tuned thresholds."""
    rules = {
        "high_value": {"threshold": amounts["high_value"]}, "structuring": {"threshold": amounts["structuring"]},
        "rapid_velocity": {"min_transactions": velocity["min_transactions"]},
    }
    Path(path).write_text(json.dumps({"rules": rules}, indent=2))
