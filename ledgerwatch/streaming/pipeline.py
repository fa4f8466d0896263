"""Ledgers as streams: JSON line files through the same rules as the batch."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch.functions import parsing

MESSAGE = (
    "external_id string, customer_name string, iban_or_acct string, account_id long, customer_id long, ts string, amount double, currency string, "
    "merchant string, counterparty string, country string, country_txn string, channel string, direction string, base_risk double"
)


def publish(spark: SparkSession, lines: Iterable[str], folder: str) -> int:
    """Appends the lines that are JSON objects to a stream folder; bad ones are left out. Returns their number."""
    good = []
    for line in lines:
        try:
            if isinstance(json.loads(line), dict):
                good.append((line,))
        except ValueError:
            continue
    if good:
        spark.createDataFrame(good, "value string").coalesce(1).write.mode("append").text(folder)
    return len(good)


def read_messages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A stream of parsed messages with an event time; text that isn't JSON has no account and falls out."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.load(folder).select(F.from_json("value", MESSAGE).alias("m")).select("m.*")
    rows = raw.where("account_id is not null or iban_or_acct is not null")
    when = parsing.stream_time(F.col("ts"), F.current_timestamp())
    key = F.coalesce("account_id", F.xxhash64("iban_or_acct"))
    return rows.withColumns({"ts": when, "account_id": key, "country": F.coalesce("country_txn", "country")})


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the delay, by event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _missing(amount: float | None) -> bool:
    return amount is None or amount != amount


class _Sums:
    """The sum of a queue's amounts, null where none is there, as in SQL.

    Nothing is taken off a sum: amounts that leave are at the end of sums of their own, so
    none leaves a remainder behind.
    """

    def __init__(self) -> None:
        self.new: list[float] = []
        self.total = 0.0
        self.old: list[float] = []

    def put(self, amount: float) -> None:
        self.new.append(amount)
        self.total += amount

    def drop(self) -> None:
        if not self.old:
            total = 0.0
            while self.new:
                total += self.new.pop()
                self.old.append(total)
            self.total = 0.0
        self.old.pop()

    def value(self) -> float | None:
        if self.old:
            return self.old[-1] + self.total
        return self.total if self.new else None


def sliding_stats(stream: DataFrame, seconds: int = 900, delay: str = "1 hour") -> DataFrame:
    """For each event, count, sum and distinct counterparties of its account's last seconds; state per account.

    State keeps the events of the window only, and goes when an account has been quiet
    for the delay.
    """

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
        # An account's rows of a batch come in several pieces and in no order: windows are made once all are here.
        for pdf in batches:
            held += zip(pdf["us"].tolist(), pdf["amount"].tolist(), pdf["counterparty"].tolist(), pdf["event_id"].tolist(), strict=True)
        held.sort(key=lambda e: e[0])
        # Both ends of the window only move on, so each event comes in once and goes once.
        out, first, end, sums, names = [], 0, 0, _Sums(), Counter()
        for us, _, _, *event in held:
            if not event:  # out already, in an earlier batch
                continue
            while end < len(held) and held[end][0] <= us:
                if not _missing(held[end][1]):
                    sums.put(held[end][1])
                names[held[end][2]] += 1
                end += 1
            while held[first][0] < us - seconds * 1_000_000:
                if not _missing(held[first][1]):
                    sums.drop()
                gone, first = held[first][2], first + 1
                names[gone] -= 1
                if not names[gone]:
                    del names[gone]
            out.append((key[0], event[0], end - first, sums.value(), len(names) - (None in names)))
        yield pd.DataFrame(out, columns=["account_id", "event_id", "n", "total", "counterparties"])
        if held:
            held = held[bisect_left(held, held[-1][0] - seconds * 1_000_000, key=lambda e: e[0]) :]
        state.update((json.dumps([e[:3] for e in held]),))
        state.setTimeoutTimestamp(max((held[-1][0] if held else 0) // 1000 + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", delay).select("account_id", "event_id", F.unix_micros("ts").alias("us"), "amount", "counterparty", "ts")
    return rows.groupBy("account_id").applyInPandasWithState(
        run, "account_id long, event_id long, n long, total double, counterparties long", "events string", "append", "EventTimeTimeout"
    )


class Bus:
    """Listeners that are called with each new alert; one that fails doesn't stop the others."""

    def __init__(self) -> None:
        self._listeners: list[Callable[[dict[str, Any]], None]] = []

    def register(self, f: Callable[[dict[str, Any]], None]) -> None:
        if f not in self._listeners:
            self._listeners.append(f)

    def remove(self, f: Callable[[dict[str, Any]], None]) -> None:
        if f in self._listeners:
            self._listeners.remove(f)

    def emit(self, event: dict[str, Any]) -> int:
        done = 0
        for f in list(self._listeners):
            try:
                f(event)
                done += 1
            except Exception:  # noqa: BLE001 a listener's error is its own
                continue
        return done


def run_rules(
    messages: DataFrame, history: Callable[[], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], config: Mapping[str, Any], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Each micro-batch through the rule pack over history and batch; sink gets scored rows and alerts.

    A replayed batch has the same number, by which the sink can tell it.
    """
    from ledgerwatch.operators.rules import alerts_of
    from ledgerwatch.plans.rule_pack import scored

    longest = max((p.get("window_minutes", 0) for p in config["rules"].values() if p.get("enabled", True)), default=0)

    def each(batch: DataFrame, number: int) -> None:
        # Known transactions and repeats in the batch fall out by their id.
        fresh = batch.dropDuplicates(["external_id"]).withColumn("id", F.xxhash64("external_id"))
        past = history()
        fresh = fresh.join(past.select("id"), "id", "left_anti")
        names = ["id", "account_id", "customer_id", "ts", "amount", "counterparty", "country", "base_risk"]
        # Windows reach back by the longest one at most, over accounts and over the customers that own them.
        oldest = fresh.agg(F.min("ts")).first()[0]
        if oldest is None:
            return
        near = past.where(F.col("ts") >= F.lit(oldest) - F.make_dt_interval(mins=F.lit(longest)))
        near = near.join(fresh.select("customer_id").distinct(), "customer_id", "left_semi").select(*names).withColumn("__new", F.lit(False))
        rows = fresh.select(*names).withColumn("__new", F.lit(True)).unionByName(near)
        out = scored(rows, config).where("__new").drop("__new")
        alerts = alerts_of(out).dropDuplicates(["transaction_id", "rule_id"]).withColumn("correlation_id", F.lit(f"stream-{number}"))
        sink(out, alerts, number)

    w = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def status(query: StreamingQuery) -> dict[str, Any]:
    """What the last batch did."""
    p = query.lastProgress
    return {"active": query.isActive, "rows": p["numInputRows"] if p else 0, "batch": p["batchId"] if p else None}
