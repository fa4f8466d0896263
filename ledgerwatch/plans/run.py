"""A run of the rules over a store: alerts, scores and a checkpoint in the audit log, in chunks and resumable."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators import lifecycle, rules, screening
from ledgerwatch.plans import rule_pack
from ledgerwatch.sources.ledger_files import numbered
from ledgerwatch.sources.store import Store

#: What a run keeps between its chunks; scored once, read by each chunk.
STAGED = "scored_rows"


def in_context(txns: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions with their account's customer and its base risk; those without an account are left out."""
    a = accounts.select(F.col("id").alias("account_id"), "customer_id")
    c = customers.select(F.col("id").alias("customer_id"), "base_risk")
    return txns.join(a, "account_id").join(c, "customer_id")


def hits_of_run(
    txns: DataFrame, config: Mapping[str, Any], now: datetime, sanctions: DataFrame | None = None, pep: DataFrame | None = None,
    own: Mapping[str, tuple[DataFrame, str, str]] | None = None,
) -> DataFrame:
    """rule_pack.scored() with rings and screening where the configuration has them, and a caller's own hits."""
    more = dict(own or {})
    ring, screen = config["rules"]["network_ring"], config["rules"]["sanctions_screening"]
    if ring.get("enabled", True):
        more["ring"] = (rule_pack.ring_hits(txns, F.lit(now), ring), "transaction_id", "id")
    if screen.get("enabled", True):
        more["screening"] = (screening.screening_hits(txns, sanctions, pep, screen), "counterparty", "counterparty")
    return rule_pack.scored(txns, config, more)


def _hash_of_rule() -> Column:
    """The hash of the rule that rule_id names."""
    return F.substring(F.sha2(F.concat("rule_id", F.lit(":v1")), 256), 1, 16)


def alert_rows(scored: DataFrame, run: str, now: datetime, there: DataFrame, last_id: int = 0) -> DataFrame:
    """Rows of the alert table from scored rows, numbered by transaction and rule order behind last_id.

    Those that there holds for this run, by transaction, rule and evidence, are left out.
    """
    versions = scored.select(F.col("id").alias("transaction_id"), "config_hash", "rules_version", "engine_version")
    rows = rules.alerts_of(scored).join(versions, "transaction_id").withColumn("__order", F.struct("transaction_id", "seq"))
    body = F.expr("substring(evidence_fields, 1, length(evidence_fields) - 1)")
    comma = F.when(F.col("evidence_fields") == "{}", "").otherwise(",")
    hashed = F.concat(body, comma, F.lit('"rule_hash":"'), _hash_of_rule(), F.lit('"}'))
    out = rows.withColumns({
        "evidence_fields": hashed, "correlation_id": F.lit(run), "status": F.lit("open"), "disposition": F.lit(None).cast("string"),
        "created_at": F.lit(now), "updated_at": F.lit(None).cast("timestamp"),
    })
    same = ["transaction_id", "rule_id", "evidence_fields"]
    out = out.join(there.where(F.col("correlation_id") == run).select(*same), same, "left_anti")
    return numbered(out, "__order", last_id)


def run_rules(
    store: Store, config: Mapping[str, Any], clock: Callable[[], datetime], chunk: int = 0, resume: str | None = None,
    sanctions: DataFrame | None = None, pep: DataFrame | None = None, own: Mapping[str, tuple[DataFrame, str, str]] | None = None,
) -> tuple[int, int]:
    """Runs the enabled rules over the store's transactions; returns the numbers of transactions and of alerts.

    Windows see the whole ledger: rows are scored once, into the store. Each chunk of transactions (all of
    them for 0) then appends its alerts and an audit row that names the last transaction, in this order.
    A run that is resumed goes on behind that row; alerts that a lost chunk left behind it are found by
    their transaction and aren't written again. At the end scores and versions go to the transactions.
    """
    started = clock()
    with lifecycle.acting(lifecycle.current_actor(), resume or lifecycle.current_run()) as run:
        txns = store.read("transactions")
        context = in_context(txns.drop("risk_score", "config_hash", "rules_version", "engine_version"), store.read("accounts"), store.read("customers"))
        last = lifecycle.last_processed(store.read("audit_logs"), run) if resume else None
        store.replace(STAGED, hits_of_run(context, config, started, sanctions, pep, own))
        staged = store.read(STAGED)
        processed, alerts, index = 0, 0, 0
        while True:
            rest = staged if last is None else staged.where(F.col("id") > last)
            part = rest.orderBy("id").limit(chunk) if chunk > 0 else rest
            n, upper = part.agg(F.count(F.lit(1)), F.max("id")).first()
            if not n:
                break
            rows = rest.where(F.col("id") <= upper)
            there = store.read("alerts")
            top = there.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            new = alert_rows(rows, run, clock(), there, top)
            store.append("alerts", new.select(*there.columns))
            made = store.read("alerts").where((F.col("correlation_id") == run) & (F.col("id") > top)).count()
            processed, alerts, last = processed + n, alerts + made, upper
            first = rows.select("config_hash", "rules_version", "engine_version").first()
            lifecycle.log(store, [lifecycle.audit("run_rules", "batch", "all", clock(), {
                "processed": processed, "alerts_created": alerts, "duration_seconds": round((clock() - started).total_seconds(), 3),
                **(first.asDict() if first else {}), "chunk_index": index, "last_processed_id": last,
            })])
            index += 1
            if chunk <= 0 or n < chunk:
                break
        marks = staged.select("id", "risk_score", "config_hash", "rules_version", "engine_version")
        store.replace("transactions", txns.drop(*marks.columns[1:]).join(marks, "id", "left").select(*txns.columns))
    return processed, alerts


def details(log: DataFrame) -> list[dict[str, Any]]:
    """The details of a run's audit rows, in order."""
    return [json.loads(r[0]) for r in log.where("action = 'run_rules'").orderBy("id").select("details_json").collect()]
