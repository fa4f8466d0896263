"""The rule pack as one plan: hits, score and band of every transaction, then alerts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch import RULES_VERSION, __version__
from ledgerwatch.config import config_hash
from ledgerwatch.functions import scoring
from ledgerwatch.operators import graph, rules


def ring_hits(txns: DataFrame, as_of: Column, params: Mapping[str, Any]) -> DataFrame:
    """transaction_id and ring: the hit of each ring account, on its transaction of the least id."""
    found = graph.rings(graph.ring_signals(graph.build_edges(txns), as_of, params["lookback_days"]), params["min_shared"], params["min_linked"])
    first = txns.groupBy("account_id").agg(F.min("id").alias("transaction_id"))
    reason = F.concat(F.size("linked_accounts").cast("string"), F.lit(" linked accounts share "), F.col("overlap_count").cast("string"), F.lit(" counterparties"))
    h = rules.hit(
        "NetworkRingIndicator", params, reason, linked_accounts=F.col("linked_accounts"), shared_counterparties=F.col("shared_counterparties"),
        overlap_count=F.col("overlap_count"), degree=F.col("degree"), lookback_days=F.lit(params["lookback_days"]),
    )
    return found.join(first, "account_id").select("transaction_id", F.array(h.cast(rules.HIT)).alias("ring"))


def scored(txns: DataFrame, config: Mapping[str, Any], more: Mapping[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """txns with hits, risk_score, band and the versions that made them.

    more: arrays of hits from other plans, {column: (frame, its key, the key in txns)}.
    """
    s = config["scoring"]
    for col, (frame, key, mine) in (more or {}).items():
        side = frame.select(F.col(key).alias("__key"), F.col(col))
        txns = txns.join(side, txns[mine] == side["__key"], "left").drop("__key")
    out = rules.with_hits(txns, config, more=tuple(more or ()))
    base = F.coalesce("base_risk", F.lit(float(s["base_risk"])))
    out = out.withColumn("risk_score", scoring.score_v1(base, F.col("hits"), s["max_score"]))
    return out.withColumns({
        "band": scoring.band(F.col("risk_score"), s["low"], s["medium"]), "config_hash": F.lit(config_hash(config)),
        "rules_version": F.lit(RULES_VERSION), "engine_version": F.lit(__version__),
    })


def stateless(txns: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Score from the rules that need no history: amount, keyword and country."""
    few = (rules.HIGH_VALUE, rules.KEYWORD, rules.COUNTRY)
    out = rules.with_hits(txns, config, few)
    s = config["scoring"]
    score = scoring.score_v1(F.coalesce("base_risk", F.lit(float(s["base_risk"]))), F.col("hits"), s["max_score"])
    return out.withColumns({"risk_score": score, "band": scoring.band(score, s["low"], s["medium"])})


def alerts_after(scored_rows: DataFrame, prior: DataFrame | None, correlation_id: str) -> DataFrame:
    """Alerts with ids within the run; those that the run has already are left out."""
    out = rules.alerts_of(scored_rows).withColumn("correlation_id", F.lit(correlation_id))
    if prior is not None:
        out = out.join(prior.where(F.col("correlation_id") == correlation_id).select("transaction_id", "rule_id"), ["transaction_id", "rule_id"], "left_anti")
    return out


def resumed(txns: DataFrame, last_id: int | None) -> DataFrame:
    """Transactions behind the last one that a run has processed."""
    return txns if last_id is None else txns.where(F.col("id") > last_id)


def first_per_account(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
