"""Key figures, deadlines, case roll-ups and reports; every time comes as as_of."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.sources.shared import ranged

# Filing deadlines in days, usual and with an extension.
DEADLINES: dict[str, tuple[int, int]] = {"fincen": (30, 60), "fca": (15, 30), "amld": (30, 45)}
OPEN = ("NEW", "INVESTIGATING", "ESCALATED")
DAY = 86_400_000_000


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, with their fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / float(DAY)


def period(alerts: DataFrame, as_of: Column, days: int) -> DataFrame:
    return alerts.where(F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days)))


def kpi_summary(alerts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: alerts, dispositioned ones, SAR and false-positive rate, mean days to a disposition."""
    a = period(alerts, as_of, days)
    n = F.count_if(F.col("disposition").isNotNull())
    rate = lambda d: F.coalesce(F.count_if(F.col("disposition") == d) / F.nullif(n, F.lit(0)), F.lit(0.0))
    took = F.when(F.col("disposition").isNotNull() & F.col("updated_at").isNotNull(), days_between(F.col("created_at"), F.col("updated_at")))
    return a.agg(
        F.count(F.lit(1)).alias("total_alerts"), n.alias("dispositioned"), F.round(rate("sar"), 4).alias("sar_rate"),
        F.round(rate("false_positive"), 4).alias("false_positive_rate"), F.round(F.avg(took), 4).alias("avg_days_to_disposition"),
    )


def kpi_counts(alerts: DataFrame, col: str, as_of: Column, days: int = 30) -> DataFrame:
    """n by a column; a null disposition is pending."""
    c = F.coalesce(F.col(col), F.lit("pending"))
    return period(alerts, as_of, days).groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("n"))


def top_rules(alerts: DataFrame, as_of: Column, days: int = 30, k: int = 10) -> DataFrame:
    return kpi_counts(alerts, "rule_id", as_of, days).orderBy(F.desc("n"), "rule_id").limit(k)


def backlog(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Open alerts by age in whole days: under 7, 14, 30, and the rest."""
    d = F.floor(days_between(F.col("created_at"), as_of))
    name = F.when(d < 7, "0-7").when(d < 14, "7-14").when(d < 30, "14-30").otherwise("30+")
    return alerts.where("status = 'open'").groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def trend(alerts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """day and n from the cutoff on; days without alerts have 0."""
    a = period(alerts, as_of, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    first = F.to_date(as_of - F.make_dt_interval(days=F.lit(days)))
    spine = alerts.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("day"))
    return spine.join(a, "day", "full").select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def deadline(created: Column, regulation: str = "fincen", extended: bool = False) -> Column:
    if regulation not in DEADLINES:
        raise ValueError(f"unknown regulation {regulation!r}; there are {', '.join(DEADLINES)}")
    return created + F.make_dt_interval(days=F.lit(DEADLINES[regulation][extended]))


def overdue_cases(cases: DataFrame, items: DataFrame, alerts: DataFrame, as_of: Column, regulation: str = "fincen") -> DataFrame:
    """Open cases whose earliest alert's deadline has passed, the longest overdue first."""
    a = alerts.select(F.col("id").alias("alert_id"), F.col("created_at").alias("alert_at"))
    firsts = items.join(a, "alert_id").groupBy("case_id").agg(F.min("alert_at").alias("first_alert_at"), F.count(F.lit(1)).alias("alert_count"))
    rows = cases.where(F.col("status").isin(*OPEN)).join(firsts, F.col("id") == F.col("case_id"))
    rows = rows.withColumn("deadline", deadline(F.col("first_alert_at"), regulation)).where(F.col("deadline") < as_of)
    out = rows.select("case_id", "status", "priority", "first_alert_at", "deadline", "alert_count", F.floor(days_between(F.col("deadline"), as_of)).cast("bigint").alias("days_overdue"))
    return out.orderBy(F.desc("days_overdue"), "case_id")


def timeline_metrics(cases: DataFrame, items: DataFrame, alerts: DataFrame, as_of: Column, regulation: str = "fincen") -> DataFrame:
    """One row: open, closed and overdue cases, mean days from the first alert to closing, share closed in time."""
    a = alerts.select(F.col("id").alias("alert_id"), F.col("created_at").alias("alert_at"))
    firsts = items.join(a, "alert_id").groupBy("case_id").agg(F.min("alert_at").alias("first_alert_at"))
    rows = cases.join(firsts, F.col("id") == F.col("case_id"), "left")
    is_open, closed = F.col("status").isin(*OPEN), F.col("status") == "CLOSED"
    due = deadline(F.col("first_alert_at"), regulation)
    took = F.when(closed, days_between(F.col("first_alert_at"), F.col("updated_at")))
    return rows.agg(
        F.count_if(is_open).alias("open_cases"), F.count_if(closed).alias("closed_cases"), F.count_if(is_open & (due < as_of)).alias("overdue_cases"),
        F.round(F.avg(took), 4).alias("avg_days_to_close"),
        F.round(F.coalesce(F.count_if(closed & (F.col("updated_at") <= due)) / F.nullif(F.count_if(closed & due.isNotNull()), F.lit(0)), F.lit(0.0)), 4).alias("on_time_rate"),
    )


def case_transactions(items: DataFrame, alerts: DataFrame) -> DataFrame:
    """Distinct case_id and transaction_id, direct or through an alert."""
    a = alerts.select(F.col("id").alias("alert_id"), F.col("transaction_id").alias("t"))
    through = items.where("alert_id is not null").join(a, "alert_id").select("case_id", F.col("t").alias("transaction_id"))
    return items.where("transaction_id is not null").select("case_id", "transaction_id").union(through).distinct()


def sar_rollup(items: DataFrame, alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Per case: amount, period, channels, accounts, rules and counts."""
    t = txns.select(F.col("id").alias("transaction_id"), "amount", "ts", "channel", "account_id")
    money = case_transactions(items, alerts).join(t, "transaction_id").groupBy("case_id").agg(
        F.sum("amount").alias("total_amount"), F.min("ts").alias("period_start"), F.max("ts").alias("period_end"), F.count(F.lit(1)).alias("txn_count"),
        F.sort_array(F.collect_set("channel")).alias("channels"), F.sort_array(F.collect_set("account_id")).alias("account_ids"),
    )
    rules = items.join(alerts.select(F.col("id").alias("alert_id"), "rule_id"), "alert_id").groupBy("case_id").agg(
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids"), F.count_distinct("alert_id").alias("alert_count")
    )
    return money.join(rules, "case_id", "left")


def sar_flat(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Alerts with their transaction and the hours to their disposition (2 places, null while there is none)."""
    t = txns.select(F.col("id").alias("transaction_id"), F.col("amount").alias("txn_amount"), F.col("ts").alias("txn_ts"), F.col("account_id").alias("txn_account_id"))
    hours = F.when(F.col("updated_at").isNotNull(), F.round(days_between(F.col("created_at"), F.col("updated_at")) * 24, 2))
    names = ["id", "transaction_id", "rule_id", "severity", "score", "status", "disposition", "created_at"]
    return alerts.join(t, "transaction_id").select(*names, "txn_account_id", "txn_amount", "txn_ts", hours.alias("hours_to_disposition"))


def risk_profiles(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Per account: alerts by severity, days since the last, weighted risk by volume and recency."""
    from ledgerwatch.functions.scoring import SEVERITY_WEIGHTS, lookup, recency_factor

    a = alerts.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_WEIGHTS],
        F.sum(lookup(F.col("severity"), SEVERITY_WEIGHTS, 1.0)).alias("weight"), F.max("created_at").alias("last_at"),
    )
    days = days_between(F.col("last_at"), as_of)
    risk = F.col("weight") * F.least(F.col("n") / 5, F.lit(3.0)) * recency_factor(days)
    return a.withColumns({"days_since_last": F.round(days, 2), "risk": F.round(risk, 2)}).drop("weight", "last_at")


def chain_breaks(logs: DataFrame) -> DataFrame:
    """Rows (by id) whose prev_hash isn't the row_hash before, over rows with a hash.

    Rows are ranged by id; within a range neighbours are compared, and each range's first row with the
    last of the range before, so no task holds the whole log.
    """
    rows = logs.where("row_hash is not null").select("id", "prev_hash", "row_hash")
    parts = ranged(rows, "id", "part")
    inside = Window.partitionBy("part").orderBy("id")
    ends = parts.groupBy("part").agg(F.max_by("row_hash", "id").alias("end"))
    before = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end_before"))
    j = parts.withColumn("lagged", F.lag("row_hash").over(inside)).join(F.broadcast(before), "part")
    j = j.withColumn("expected", F.coalesce("lagged", "end_before"))
    return j.where(~F.col("prev_hash").eqNullSafe(F.col("expected"))).select("id", "prev_hash", "expected")


def audit_summary(alerts: DataFrame, cases: DataFrame, logs: DataFrame) -> DataFrame:
    """metric and n: alerts by severity and disposition, cases by status, audit rows by action."""
    of = lambda df, name, col: df.groupBy(F.concat(F.lit(f"{name}:"), F.coalesce(F.col(col), F.lit("pending"))).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    out = of(alerts, "severity", "severity").unionByName(of(alerts, "disposition", "disposition"))
    return out.unionByName(of(cases, "status", "status")).unionByName(of(logs, "action", "action"))


def run_bundle(correlation_id: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What belongs to a run: its audit rows and alerts, their transactions, cases with items and notes, edges, and versions."""
    mine = {n: tables[n].where(F.col("correlation_id") == correlation_id) for n in ("audit_logs", "alerts", "cases", "relationship_edges") if n in tables and "correlation_id" in tables[n].columns}
    alerts = mine["alerts"]
    out = {**mine, "audit_logs": mine["audit_logs"].orderBy("ts", "id"), "alerts": alerts.orderBy("id")}
    out["transactions"] = tables["transactions"].join(alerts.select(F.col("transaction_id").alias("id")), "id", "left_semi")
    case_ids = mine["cases"].select(F.col("id").alias("case_id"))
    for n in ("case_items", "case_notes"):
        if n in tables:
            out[n] = tables[n].join(case_ids, "case_id", "left_semi")
    distinct = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    out["versions"] = alerts.agg(*[distinct(c) for c in ("config_hash", "rules_version", "engine_version")])
    return out


def audit_zip(frames: Mapping[str, DataFrame], summary: Mapping[str, Any]) -> bytes:
    """A ZIP of JSON (and CSV where there are rows) of each frame, and summary.json. For a period that one person reads."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in frames.items():
            rows = [json.loads(r) for (r,) in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator()]
            z.writestr(f"{name}.json", json.dumps(rows, indent=1))
            if rows:
                text = io.StringIO()
                w = csv.DictWriter(text, fieldnames=df.columns)
                w.writeheader()
                w.writerows(rows)
                z.writestr(f"{name}.csv", text.getvalue())
        z.writestr("summary.json", json.dumps(dict(summary), indent=1, default=str))
    return out.getvalue()


def write_sar_report(alerts: DataFrame, txns: DataFrame, folder: str, now: datetime, evidence: bool = True) -> DataFrame:
    """sar_flat() with reason and evidence below folder, in order of creation: alerts.json (lines), alerts.csv without evidence, generated_at.json.

    Files are written by the executors, one folder each, so their size doesn't matter.
    """
    t = txns.select(F.col("id").alias("transaction_id"), *[c for c in ("amount", "currency", "ts", "account_id", "counterparty", "country") if c in txns.columns])
    hours = F.when(F.col("updated_at").isNotNull(), F.round(days_between(F.col("created_at"), F.col("updated_at")) * 24, 2)).alias("hours_to_disposition")
    own = [F.col("id").alias("alert_id"), "transaction_id", "rule_id", "severity", "reason", "evidence_fields", "created_at", "updated_at", hours]
    mine = alerts.select(*own)
    out = mine.join(t, "transaction_id").select(*mine.columns, *t.columns[1:]).orderBy("created_at", "alert_id")
    plain = out.drop("evidence_fields")
    (out.withColumnRenamed("evidence_fields", "evidence") if evidence else plain).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/alerts.json")
    plain.write.mode("overwrite").option("header", True).csv(f"{folder}/alerts.csv")
    alerts.sparkSession.createDataFrame([(now.isoformat(),)], "generated_at string").coalesce(1).write.mode("overwrite").json(f"{folder}/generated_at.json")
    return out


def sar_document(
    case_row: Mapping[str, Any], filer: Mapping[str, str], narrative: str = "", subject: Mapping[str, Any] | None = None, report_id: str = "",
    filing_type: str = "INITIAL", alert_ids: Sequence[int] = (), now: datetime | None = None,
) -> dict[str, Any]:
    """The SAR of one case from its roll-up, in the fields of an electronic filing."""
    day = lambda t: t.isoformat() if isinstance(t, datetime) else t
    who = {"name": "", "country": "", "account_numbers": [str(a) for a in case_row["account_ids"] or []], **(subject or {})}
    rules = list(case_row["rule_ids"] or [])
    return {
        "report_id": report_id, "filing_type": filing_type, "filer": {"name": "", "ein": "", "address": "", **filer}, "subject": who,
        "suspicious_activity": {
            "description": f"{case_row['txn_count']} transactions, rules: {', '.join(rules)}", "total_amount": case_row["total_amount"],
            "date_range_start": day(case_row["period_start"]), "date_range_end": day(case_row["period_end"]),
            "instruments": list(case_row["channels"] or []), "activity_types": rules,
        },
        "narrative": narrative, "case_id": case_row["case_id"], "alert_ids": list(alert_ids), "generated_at": day(now),
    }


# The filing's elements and the fields of a document that fill them; a list's element and its items' are joined by a slash.
FILING = {
    "FilingInfo": {"ReportID": "report_id", "FilingType": "filing_type", "GeneratedAt": "generated_at"},
    "Filer": {"Name": "filer.name", "EIN": "filer.ein", "Address": "filer.address"},
    "Subject": {"Name": "subject.name", "Country": "subject.country", "AccountNumbers/Account": "subject.account_numbers"},
    "SuspiciousActivity": {
        "Description": "suspicious_activity.description", "TotalAmount": "suspicious_activity.total_amount",
        "DateRangeStart": "suspicious_activity.date_range_start", "DateRangeEnd": "suspicious_activity.date_range_end",
        "Instruments/Instrument": "suspicious_activity.instruments", "ActivityTypes/Type": "suspicious_activity.activity_types",
    },
    "Narrative": "narrative",
    "References": {"CaseID": "case_id", "/AlertID": "alert_ids"},
}
FILING_ROOT, FILING_SPACE = "BSAReport", "https://www.fincen.gov/bsa"


def to_xml(document: Mapping[str, Any], shape: Mapping[str, Any] = FILING) -> str:
    """A document of sar_document() as XML; elements without a value are left out, amounts have two places."""

    def put(parent: ET.Element, elements: Mapping[str, Any]) -> None:
        for name, source in elements.items():
            if isinstance(source, Mapping):
                put(ET.SubElement(parent, name), source)
                continue
            value: Any = document
            for part in source.split("."):
                value = value[part]
            outer, slash, inner = name.partition("/")
            if slash:
                holder = ET.SubElement(parent, outer) if outer else parent
                for v in value:
                    ET.SubElement(holder, inner).text = str(v)
            elif value is not None:
                ET.SubElement(parent, name).text = f"{value:.2f}" if isinstance(value, float) else str(value)

    top = ET.Element(FILING_ROOT, xmlns=FILING_SPACE)
    put(top, shape)
    return ET.tostring(top, encoding="unicode", xml_declaration=True)


def recommendation(mean_score: float, severities: Mapping[str, int]) -> str:
    """What a report suggests, by its worst alerts and mean score."""
    if severities.get("critical") or mean_score >= 75:
        return "file"
    if severities.get("high") or mean_score >= 50:
        return "escalate"
    return "monitor" if mean_score >= 25 else "close"


def report_sections(case_id: int, items: DataFrame, alerts: DataFrame, txns: DataFrame, most: int = 50) -> dict[str, DataFrame]:
    """The frames of a case report: alerts, severities, mean score, and the first transactions in time."""
    mine = items.where(F.col("case_id") == case_id)
    a = alerts.join(mine.where("alert_id is not null").select(F.col("alert_id").alias("id")), "id", "left_semi")
    ids = case_transactions(mine, alerts).select(F.col("transaction_id").alias("id"))
    return {
        "alerts": a, "severities": a.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "score": a.agg(F.avg("score").alias("mean_score")),
        "transactions": txns.join(ids, "id", "left_semi").orderBy("ts", "id").limit(most),
    }
