"""Detection rules as columns over transactions.

A rule is a struct (rule_id, severity, reason, evidence, score_delta), null where it
doesn't fire. Window rules share one partitioning by account and one order by
time, so one exchange and one sort serve them all; the country rule is by customer
and needs another. Frames are RANGE frames: both ends belong to them and rows of
equal time count for one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HIT = "struct<rule_id:string,severity:string,reason:string,evidence:string,score_delta:double>"


def _over(value: Column, by: str, seconds: int) -> Column:
    """value over the trailing frame; times are compared in microseconds."""
    return value.over(Window.partitionBy(by).orderBy(F.col("__us")).rangeBetween(-seconds * 1_000_000, 0))


def hit(rule_id: str, params: Mapping[str, Any], reason: Column, severity: Column | None = None, delta: Column | None = None, **evidence: Column) -> Column:
    """The struct of a rule that has fired."""
    return F.struct(
        F.lit(rule_id).alias("rule_id"), (F.lit(params.get("severity", "medium")) if severity is None else severity).alias("severity"),
        reason.alias("reason"), F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])).alias("evidence"),
        (F.lit(float(params["score_delta"])) if delta is None else delta).alias("score_delta"),
    )


def rule_hash(rule_id: str, version: str = "v1") -> str:
    return hashlib.sha256(f"{rule_id}:{version}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Rule:
    """name in the configuration, id on alerts, columns that it needs and its struct from parameters."""

    name: str
    rule_id: str
    columns: Callable[[Mapping[str, Any]], dict[str, Column]] = field(default=lambda p: {})
    fires: Callable[[Mapping[str, Any]], Column] = field(default=lambda p: F.lit(None).cast(HIT))

    @property
    def hash(self) -> str:
        return rule_hash(self.rule_id)


def _high_value(p: Mapping[str, Any]) -> Column:
    a, t = F.col("amount"), F.lit(float(p["threshold"]))
    reason = F.concat(F.lit("Amount "), a.cast("string"), F.lit(" >= threshold "), t.cast("string"))
    return F.when(a >= t, hit("HighValueTransaction", p, reason, amount=a, threshold=t))


def _velocity(p: Mapping[str, Any]) -> Column:
    n = F.col("__velocity")
    reason = F.concat(n.cast("string"), F.lit(f" transactions in {p['window_minutes']} minutes"))
    return F.when(
        n >= p["min_transactions"],
        hit("RapidVelocity", p, reason, count=n, window_minutes=F.lit(p["window_minutes"]), account_id=F.col("account_id")),
    )


def _geo(p: Mapping[str, Any]) -> Column:
    seen = F.array_sort("__countries")
    fires = (F.size(seen) > p["max_countries"]) & F.col("country").isNotNull() & (F.col("country") != "")
    reason = F.concat(F.size(seen).cast("string"), F.lit(f" countries in {p['window_minutes']} minutes"))
    return F.when(fires, hit("GeoMismatch", p, reason, countries=seen, window_minutes=F.lit(p["window_minutes"])))


def in_band(amount: Column, threshold: float) -> Column:
    """Just below the threshold: from 0.8 of it on."""
    return (amount >= 0.8 * threshold) & (amount < threshold)


def _structuring(p: Mapping[str, Any]) -> Column:
    n = F.col("__structuring")
    reason = F.concat(n.cast("string"), F.lit(f" transactions just below {float(p['threshold'])} in {p['window_minutes']} minutes"))
    return F.when(
        n >= p["min_transactions"],
        hit("StructuringSmurfing", p, reason, count=n, threshold=F.lit(float(p["threshold"])), window_minutes=F.lit(p["window_minutes"])),
    )


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of the keywords, in their order, that the text contains, whatever its case."""
    low = F.lower(text)
    found = [F.when(low.contains(k.lower()), F.lit(k)) for k in keywords]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _keyword(p: Mapping[str, Any]) -> Column:
    c, k = F.col("counterparty"), first_keyword(F.col("counterparty"), p["keywords"])
    reason = F.concat(F.lit("Counterparty matches keyword '"), k, F.lit("'"))
    return F.when(
        k.isNotNull(),
        hit("SanctionsKeywordMatch", p, reason, counterparty=c, keyword=k, list_version=F.lit(p["list_version"]), effective_date=F.lit(p["effective_date"])),
    )


def _country(p: Mapping[str, Any]) -> Column:
    c = F.substring(F.upper(F.trim("country")), 1, 3)
    reason = F.concat(F.lit("High-risk country "), c)
    return F.when(
        c.isin(*[str(x).upper() for x in p["countries"]]),
        hit("HighRiskCountry", p, reason, country=c, list_version=F.lit(p["list_version"]), effective_date=F.lit(p["effective_date"])),
    )


HIGH_VALUE = Rule("high_value", "HighValueTransaction", fires=_high_value)
VELOCITY = Rule(
    "rapid_velocity", "RapidVelocity",
    lambda p: {"__velocity": _over(F.count(F.lit(1)), "account_id", 60 * p["window_minutes"])}, _velocity,
)
GEO = Rule(
    "geo_mismatch", "GeoMismatch",
    lambda p: {"__countries": _over(F.collect_set(F.when(F.col("country") != "", F.col("country"))), "customer_id", 60 * p["window_minutes"])}, _geo,
)
STRUCTURING = Rule(
    "structuring", "StructuringSmurfing",
    lambda p: {"__structuring": _over(F.count_if(in_band(F.col("amount"), float(p["threshold"]))), "account_id", 60 * p["window_minutes"])}, _structuring,
)
KEYWORD = Rule("sanctions_keyword", "SanctionsKeywordMatch", fires=_keyword)
COUNTRY = Rule("high_risk_country", "HighRiskCountry", fires=_country)

#: Rules over a transaction's own row and its windows, in the order of their alerts.
ROW_RULES = (HIGH_VALUE, VELOCITY, GEO, STRUCTURING, KEYWORD, COUNTRY)


def enabled(rules: tuple[Rule, ...], config: Mapping[str, Any]) -> list[tuple[Rule, Mapping[str, Any]]]:
    """The enabled rules and their parameters; others aren't in the plan at all."""
    return [(r, p) for r in rules if (p := config["rules"].get(r.name, {"enabled": False})).get("enabled", True)]


def with_hits(txns: DataFrame, config: Mapping[str, Any], rules: tuple[Rule, ...] = ROW_RULES, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds hits, the array of the rules' structs that fired, with those of the array columns in more behind them.

    txns needs id, account_id, customer_id, ts, amount, counterparty and country.
    """
    chosen = enabled(rules, config)
    out = txns.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    windows: dict[str, Column] = {}
    for r, p in chosen:
        windows |= r.columns(p)
    # Windows of one partitioning are added together.
    if windows:
        out = out.withColumns(windows)
    structs = [r.fires(p).cast(HIT) for r, p in chosen]
    fired = F.filter(F.array(*structs), lambda h: h.isNotNull()) if structs else F.array().cast(f"array<{HIT}>")
    for c in more:
        fired = F.concat(fired, F.coalesce(F.col(c), F.array().cast(f"array<{HIT}>")))
    return out.withColumn("hits", fired).drop("__us", *windows, *more)


def alerts_of(scored: DataFrame) -> DataFrame:
    """A row for each hit."""
    return scored.select(
        F.col("id").alias("transaction_id"), "account_id", F.posexplode("hits").alias("seq", "h")
    ).select("transaction_id", "account_id", "seq", "h.rule_id", "h.severity", "h.reason", F.col("h.evidence").alias("evidence_fields"), F.col("h.score_delta").alias("score"))
