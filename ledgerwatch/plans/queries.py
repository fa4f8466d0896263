"""Registered queries over the driver's tables, named after what they compute."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.config import DEFAULTS, merged
from ledgerwatch.functions import parsing, scoring
from ledgerwatch.functions.redaction import redacted
from ledgerwatch.functions.text import jaro_winkler_udf, levenshtein_similarity, phonetic_similarity
from ledgerwatch.operators import features, graph, lifecycle, paging, reporting, rules, screening, tuning
from ledgerwatch.plans import rule_pack
from ledgerwatch.schemas import NAME_LIST
from ledgerwatch.sources import ledger_files, synthetic
from ledgerwatch.sources.adapters import alerts_of_orders, cases_of_customers, ledger_deliveries, ledger_events, ledger_lineitem, ledger_orders, table
from ledgerwatch.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters under which the windows fire on the driver's data.
CONFIG = merged(DEFAULTS, {"rules": {
    "rapid_velocity": {"window_minutes": 1440}, "geo_mismatch": {"window_minutes": 1440, "max_countries": 8},
    "structuring": {"window_minutes": 10080}, "high_risk_country": {"countries": ["N1", "N7"]}, "sanctions_keyword": {"keywords": ["cp 13", "cp 7"]},
}})

#: Ends of the data, for lookbacks.
EVENTS_END = datetime(2024, 1, 31)
SHIP_END = datetime(2001, 12, 1)
#: Rings are asked for at the end of orders, when lines still ship.
RING_AT = datetime(2001, 8, 2)
ORDERS_END = datetime(2001, 8, 2)

LISTED = ["cold widgit", "blew rod", "large bolts", "new rink"]


def at(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def joined(c: str) -> Column:
    return F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",")


def _hits_of(rule: rules.Rule) -> Query:
    """The transactions on which one rule fires."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rules.with_hits(ledger_events(spark, sf_dir), CONFIG, (rule,)).where(F.size("hits") > 0)
        h = F.col("hits")[0]
        return out.select("id", "account_id", h["rule_id"].alias("rule_id"), h["severity"].alias("severity"), h["score_delta"].alias("score_delta"))

    return run


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_pack.scored(ledger_events(spark, sf_dir), CONFIG)


def rule_pack_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alerts_of(_scored(spark, sf_dir)).select("transaction_id", "account_id", "rule_id", "severity", "score")


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "account_id", F.size("hits").cast("bigint").alias("n_hits"), "risk_score", "band")


def risk_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_scores(spark, sf_dir).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def stateless_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_pack.stateless(ledger_events(spark, sf_dir), CONFIG).select("id", "risk_score", "band")


def score_v2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.with_hits(ledger_events(spark, sf_dir), CONFIG)
    made = {f"score_{n}": F.round(scoring.score_v2(F.lit(p["base_risk"]), F.col("hits"), p, F.col("ts"), at(EVENTS_END)), 4) for n, p in scoring.PROFILES.items()}
    return rows.select("id", *[c.alias(n) for n, c in made.items()])


def temporal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts_of_orders(spark, sf_dir)
    f = scoring.decay(F.col("created_at"), at(ORDERS_END)) * scoring.severity_multiplier(F.col("severity"))
    return a.groupBy("severity").agg(F.round(F.sum(F.col("score") * f), 4).alias("decayed"), F.count(F.lit(1)).alias("n"))


def customer_risk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.risk_profiles(alerts_of_orders(spark, sf_dir), at(ORDERS_END))


def _raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a dirty file: text columns under foreign headers, some rows without account or with a bad time."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.when(i % 50 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" ACC"), F.col("user_id").cast("string"), F.lit(" "))).alias("Account Number"),
        F.when(i % 70 == 5, F.lit("soon")).when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "d/M/yyyy HH:mm:ss")).alias("Value-Date"),
        F.when(i % 90 == 8, F.lit("much")).when(i % 3 == 0, F.concat(F.lit("$1,"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(".50"))).otherwise((i % 977).cast("string")).alias("Amt"),
        F.when(i % 5 == 0, F.lit("eur")).alias("CCY"), F.element_at(F.array(F.lit("low"), F.lit("M"), F.lit("3"), F.lit("7.5"), F.lit("odd")), (i % 5 + 1).cast("int")).alias("Risk Band"),
        F.col("event_type").alias("beneficiary"), i.cast("string").alias("txn_id"),
    )


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.sources.columns import resolve

    raw = _raw_ledger(spark, sf_dir)
    return ledger_files.normalized(raw, resolve(raw.columns))


def ingest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ledger_files.split_rejects(_normalized(spark, sf_dir))
    return good.select("source_id", "iban_or_acct", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "amount", "currency", "counterparty", "base_risk", "country", "customer_name")


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_files.reject_summary(_normalized(spark, sf_dir))


def external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger_events(spark, sf_dir)
    return t.select("id", parsing.external_id(F.col("account_id"), F.col("ts"), F.col("amount"), F.col("currency"), F.col("counterparty"), F.col("direction")).alias("external_id"))


def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger_events(spark, sf_dir)
    hashed = parsing.external_id(F.col("account_id"), F.col("ts"), F.round("amount", 2), F.upper("currency"), F.upper("counterparty"), F.col("direction"))
    twice = t.unionByName(t.where("id % 3 = 0").withColumn("id", F.col("id") + 10_000_000)).withColumn("external_id", hashed)
    return ledger_files.first_wins(twice, "external_id", [F.col("id")]).select("id", "account_id")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger_events(spark, sf_dir)
    return ledger_files.insert_if_absent(t, t.where("id % 4 <> 1"), "id").select("id", "account_id", "amount")


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all order lines."""
    return graph.build_edges(ledger_lineitem(spark, sf_dir), _lines(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> int:
    """The number of order lines, as the files state it."""
    return table(spark, sf_dir, "lineitem").count()


def _pairs_of_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst of the projection of all deliveries, cut where loops start from it."""
    return graph.kept(graph.projection(_delivery_edges(spark, sf_dir)).select("src", "dst"))


def _delivery_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of accounts and the parts that suppliers deliver to them, over all order lines."""
    return graph.build_edges(ledger_deliveries(spark, sf_dir), _lines(spark, sf_dir), [("account", "counterparty")])


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _supply_edges(spark, sf_dir)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return e.select("src_type", "src_id", "dst_type", "dst_key", day("first_seen_at"), day("last_seen_at"), "txn_count")


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt as the old ones are, so that they meet without another exchange.
    new = graph.build_edges(graph.since(ledger_lineitem(spark, sf_dir), "ts", at(RING_AT), 30), _lines(spark, sf_dir))
    out = graph.upsert_edges(_supply_edges(spark, sf_dir), new)
    return out.select("src_type", "src_id", "dst_type", "dst_key", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen_at"), "txn_count")


def ring_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.ring_signals(_supply_edges(spark, sf_dir), at(RING_AT))
    return s.select("account_id", F.size("linked_accounts").cast("bigint").alias("linked"), F.col("overlap_count").cast("bigint").alias("overlap_count"), "degree", joined("shared_counterparties").alias("shared"))


def ring_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph.since(ledger_lineitem(spark, sf_dir), "ts", at(RING_AT), 30)
    hits = rule_pack.ring_hits(t, at(RING_AT), CONFIG["rules"]["network_ring"])
    return hits.select("transaction_id", F.col("ring")[0]["rule_id"].alias("rule_id"), F.col("ring")[0]["score_delta"].alias("score_delta"))


def account_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graph.projection(_delivery_edges(spark, sf_dir))
    return p.select("src", "dst", "txn_count", joined("shared_counterparties").alias("shared"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen_at"))


def account_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the account of the least id, in their order, and its ring."""
    t, recent = ledger_lineitem(spark, sf_dir), at(RING_AT) - F.make_dt_interval(days=F.lit(30))
    start = t.where(graph.has_edge()).agg(F.min("account_id")).first()[0]
    # Only the account's own edges need all their transactions; of the others it asks which were seen lately.
    near = t.where((F.col("account_id") == start) | (F.col("ts") >= recent))
    e = graph.kept(graph.build_edges(near, kinds=[("account", "counterparty"), ("account", "merchant")]))
    out = graph.neighbourhood(e, start, at(RING_AT))
    return out.select("place", "dst_type", "dst_key", "txn_count", F.col("overlap_count").cast("bigint").alias("overlap_count"), F.col("linked").cast("bigint").alias("linked"), "degree")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    accounts = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("iban_or_acct"))
    customers = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("country"), F.lit(10.0).alias("base_risk"))
    n = graph.nodes(accounts, customers, ledger_orders(spark, sf_dir), alerts_of_orders(spark, sf_dir).select("id", "transaction_id"))
    return n.select("account_id", "customer_name", F.round("total_amount", 2).alias("total_amount"), "alert_count")


def _event_accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = ledger_events(spark, sf_dir)
    accounts = t.select(F.col("account_id").alias("id"), "customer_id").distinct()
    customers = accounts.select(F.col("customer_id").alias("id")).distinct()
    return accounts, customers.select("id", F.concat(F.lit("C"), F.col("id").cast("string")).alias("name"), F.lit("XXX").alias("country"), F.lit(10.0).alias("base_risk"))


def common_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts, customers = _event_accounts(spark, sf_dir)
    ids = accounts.select(F.col("id").alias("account_id"))
    return graph.common_owners(accounts, customers, ids).select("customer_id", "customer_name", joined("account_ids").alias("account_ids"))


def ownership_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ownership_links(_delivery_edges(spark, sf_dir))


def ownership_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners around the account of the least id that has a link."""
    e = _delivery_edges(spark, sf_dir)
    start = graph.ownership_links(e).agg(F.min("account_id")).first()[0]
    c = table(spark, sf_dir, "customer")
    accounts = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("customer_id"))
    out = graph.ownership_chain(e, accounts, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), start)
    return out.select("linked_account", "customer_id", "customer_name", "relation", "shared_count")


def khop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs_of_accounts(spark, sf_dir)
    start = p.agg(F.min("src")).first()[0]
    return graph.k_hop(p, start, 2).select("node", F.col("hop").cast("bigint").alias("hop"))


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs_of_accounts(spark, sf_dir)
    low, high = p.agg(F.min("src"), F.max("src")).first()
    return graph.shortest_path(p, low, high).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of three edges at most, from the least node to the largest one that is two hops away at most."""
    p = _pairs_of_accounts(spark, sf_dir)
    low = p.agg(F.min("src")).first()[0]
    high = graph.k_hop(p, low, 2).agg(F.max("node")).first()[0]
    return graph.simple_paths(p, low, high, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def money_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger_lineitem(spark, sf_dir)
    accounts = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.upper("s_name").alias("iban_or_acct"))
    f = graph.flow_edges(t, accounts, at(SHIP_END), lookback_days=90)
    return f.select("account_id", "counterparty", F.round("total_amount", 2).alias("total_amount"), "txn_count", "to_account")


def money_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where money of the account of the least id goes, three steps far; every second counterparty is an account."""
    t = ledger_events(spark, sf_dir)
    accounts = t.select(F.col("account_id").alias("id")).distinct().withColumn("iban_or_acct", F.concat(F.lit("CP "), (2 * F.col("id")).cast("string")))
    f = graph.flow_edges(t, accounts, at(EVENTS_END), lookback_days=90)
    out = graph.trace_flow(f, t.agg(F.min("account_id")).first()[0])
    return out.select("parent", "child", "counterparty", F.round("total_amount", 2).alias("total_amount"), "txn_count", F.col("depth").cast("bigint").alias("depth"))


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_pairs_of_accounts(spark, sf_dir))


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.louvain(_pairs_of_accounts(spark, sf_dir))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(_pairs_of_accounts(spark, sf_dir))


def suspicious_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("bigint").alias("community"))
    a = alerts_of_orders(spark, sf_dir).groupBy("account_id").agg(F.count_if(F.col("severity") == "critical").alias("alert_count"), F.sum("amount").alias("total_amount"))
    out = graph.suspicious(members, a)
    return out.select("community", "size", "alerts", F.round("alert_ratio", 6).alias("alert_ratio"), F.round("volume", 2).alias("volume"), "risk_score")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()


def _list_frame(spark: SparkSession) -> DataFrame:
    rows = [(i, n, [n.split()[-1] + " " + n.split()[0]], "individual", "custom", "US" if i % 2 else "IR", None, "high" if i % 2 else "low", {}) for i, n in enumerate(LISTED)]
    return spark.createDataFrame(rows, NAME_LIST)


def _pairs(spark: SparkSession, sf_dir: str, score: Callable[[Column, Column], Column], least: float) -> DataFrame:
    listed = F.broadcast(spark.createDataFrame([(n,) for n in LISTED], "entry string"))
    out = _names(spark, sf_dir).join(listed, F.lit(True)).withColumn("score", F.round(score(F.col("name"), F.col("entry")), 4))
    return out.where(F.col("score") >= least)


def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, levenshtein_similarity, 0.35)


def fuzzy_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, jaro_winkler_udf, 0.72)


def phonetic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, phonetic_similarity, 0.5)


def name_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.search(_names(spark, sf_dir), _list_frame(spark), 0.6).select("name", "entry_id", "score", "algorithm")


def pep_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.search(_names(spark, sf_dir), _list_frame(spark), 0.35, ("exact", "levenshtein"), country="ir").select("name", "entry_id", "score")


#: Names of counterparties with the keyword that stands for them where no list is loaded.
LISTED_PARTIES = [(0, "CP 13", ["CP 31"], "high"), (1, "Cp 70", [], "low")]


def _screened(spark: SparkSession, sf_dir: str, sanctions: bool) -> DataFrame:
    """Scores by the screening rule alone, with the list also taken as one of politically exposed persons."""
    from ledgerwatch.plans.run import hits_of_run

    others = {name: {"enabled": False} for name in CONFIG["rules"]}
    mine = {"enabled": True, "threshold": 0.79, "pep_threshold": 0.99, "algorithms": ["exact", "levenshtein"], "keywords": ["p 13", "cp 7"]}
    rows = [(i, n, a, "individual", "custom", "US", None, r, {}) for i, n, a, r in LISTED_PARTIES]
    listed = spark.createDataFrame(rows, NAME_LIST)
    return hits_of_run(ledger_events(spark, sf_dir), merged(CONFIG, {"rules": {**others, "sanctions_screening": mine}}), EVENTS_END, listed if sanctions else None, listed if sanctions else None)


def screening_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.alerts_of(_screened(spark, sf_dir, True)).select("transaction_id", "rule_id", "severity", "score", "evidence_fields")
    name = F.get_json_object("evidence_fields", "$.matched_name")
    return out.select("transaction_id", "rule_id", "severity", "score", name.alias("matched_name"), F.get_json_object("evidence_fields", "$.match_confidence").cast("double").alias("confidence"))


def keyword_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.alerts_of(_screened(spark, sf_dir, False))
    return out.select("transaction_id", "severity", "score", F.get_json_object("evidence_fields", "$.keyword").alias("keyword"))


def transactions_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with account and customer, as a run of the rules joins them."""
    from ledgerwatch.plans.run import in_context

    c = table(spark, sf_dir, "customer")
    accounts = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("customer_id"))
    customers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("double").alias("base_risk"))
    return in_context(ledger_orders(spark, sf_dir), accounts, customers).select("id", "account_id", "customer_id", "amount", "base_risk")


def alerts_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of one year, its first and its last day included."""
    a = paging.between(alerts_of_orders(spark, sf_dir), "created_at", at(datetime(1998, 1, 1)), at(datetime(1998, 12, 31)))
    return a.select("id", "severity", "account_id")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(spark, sf_dir)
    return ledger_files.ingest_counts(rows, ledger_files.split_rejects(rows)[0])


def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a log for each transaction, without names."""
    t = ledger_events(spark, sf_dir)
    line = F.format_string("alert %d (Counterparty: %s, merchant=%s) amount=%s", F.col("id"), F.regexp_replace("counterparty", " ", "_"), "merchant", F.col("amount").cast("string"))
    return t.select("id", redacted(line).alias("line"))


def planted_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a made-up ledger, a row for each order, holds of each pattern."""
    n = table(spark, sf_dir, "orders").count()
    made = synthetic.ledger(spark, n)
    return made.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("external_id").alias("n_ids"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "account_id", *[F.round(c, 4).alias(c) for c in features.NAMES])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.batch_features(ledger_events(spark, sf_dir)))


def online_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.online_features(ledger_events(spark, sf_dir)))


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.batch_features(ledger_events(spark, sf_dir))
    forest, _ = features.train_forest(f)
    return features.anomaly_scores(f, forest)


def tune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.amount_thresholds(ledger_orders(spark, sf_dir))


def tune_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.velocity_threshold(ledger_events(spark, sf_dir))


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.kpi_summary(alerts_of_orders(spark, sf_dir), at(ORDERS_END), 365)


def kpi_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.kpi_counts(alerts_of_orders(spark, sf_dir), "severity", at(ORDERS_END), 365)


def kpi_by_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.kpi_counts(alerts_of_orders(spark, sf_dir), "disposition", at(ORDERS_END), 365)


def kpi_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reporting.trend(alerts_of_orders(spark, sf_dir), at(ORDERS_END), 365)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def kpi_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.backlog(alerts_of_orders(spark, sf_dir), at(ORDERS_END))


def kpi_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.top_rules(alerts_of_orders(spark, sf_dir), at(ORDERS_END), 365, 5)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts_of_orders(spark, sf_dir)
    by_alert = a.select(F.col("account_id").alias("case_id"), F.col("id").alias("alert_id"), F.lit(None).cast("bigint").alias("transaction_id"))
    return by_alert.unionByName(a.where("id % 10 = 0").select(F.col("account_id").alias("case_id"), F.lit(None).cast("bigint").alias("alert_id"), "transaction_id"))


def overdue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reporting.overdue_cases(cases_of_customers(spark, sf_dir), _items(spark, sf_dir), alerts_of_orders(spark, sf_dir), at(ORDERS_END))
    return out.select("case_id", "status", "priority", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), "alert_count", "days_overdue")


def timeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.timeline_metrics(cases_of_customers(spark, sf_dir), _items(spark, sf_dir), alerts_of_orders(spark, sf_dir), at(ORDERS_END), "amld")


def sar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ledger_orders(spark, sf_dir).withColumn("channel", F.concat(F.lit("ch"), (F.col("id") % 4).cast("string")))
    out = reporting.sar_rollup(_items(spark, sf_dir), alerts_of_orders(spark, sf_dir), t)
    return out.select("case_id", F.round("total_amount", 2).alias("total_amount"), F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "txn_count", joined("channels").alias("channels"), joined("rule_ids").alias("rule_ids"), "alert_count")


def sar_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reporting.sar_flat(alerts_of_orders(spark, sf_dir), ledger_orders(spark, sf_dir))
    return out.select("id", "rule_id", "severity", "status", "disposition", "txn_account_id", "txn_amount", "hours_to_disposition")


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit log with hashes, every 97th link broken."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"))
    h = lambda c: F.sha2(c.cast("string"), 256)
    prev = F.when(F.col("id") % 97 == 96, F.lit("broken")).when(F.col("id") > 0, h(F.col("id") - 1))
    return e.withColumns({"row_hash": h(F.col("id")), "prev_hash": prev})


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.chain_breaks(_logs(spark, sf_dir))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.audit_summary(alerts_of_orders(spark, sf_dir), cases_of_customers(spark, sf_dir), _logs(spark, sf_dir))


def alerts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = paging.equal_to(alerts_of_orders(spark, sf_dir), severity="high")
    return paging.page(a, 50, paging.encode_cursor(1000)).select("id", "severity", "account_id")


def case_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases_of_customers(spark, sf_dir).select("id", "status")
    out = paging.with_children(c, {"items": (_items(spark, sf_dir).where("alert_id is not null").select("case_id", "alert_id"), "case_id")})
    return out.select("id", "status", F.size("items").cast("bigint").alias("n_items"), F.array_join(F.transform("items", lambda x: x["alert_id"].cast("string")), ",").alias("alert_ids"))


def case_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = [(s,) for s in lifecycle.CASE_MOVES]
    a, b = spark.createDataFrame(states, "old string"), spark.createDataFrame(states, "new string")
    return a.crossJoin(b).select("old", "new", lifecycle.allowed(F.col("old"), F.col("new")).alias("allowed"))


def run_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts_of_orders(spark, sf_dir).withColumns({"correlation_id": F.concat(F.lit("run"), (F.col("id") % 5).cast("string")), "config_hash": F.lit("c"), "rules_version": F.lit("1"), "engine_version": F.lit("1")})
    logs = _logs(spark, sf_dir).withColumns({"correlation_id": F.concat(F.lit("run"), (F.col("id") % 5).cast("string")), "ts": F.col("id")})
    c = cases_of_customers(spark, sf_dir).withColumn("correlation_id", F.concat(F.lit("run"), (F.col("id") % 5).cast("string")))
    b = reporting.run_bundle("run2", {"alerts": a, "audit_logs": logs, "cases": c, "transactions": ledger_orders(spark, sf_dir), "case_items": _items(spark, sf_dir)})
    parts = [b[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in ("alerts", "audit_logs", "cases", "transactions", "case_items")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts_of_orders(spark, sf_dir)
    return a.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events twice through a stream: each id comes out once."""
    from ledgerwatch.streaming.pipeline import deduplicated

    name, e = f"dedup_{datetime.now():%H%M%S%f}", spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(e).format("parquet").load(_stream_copy(spark, sf_dir))
    rows = s.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = deduplicated(rows.unionByName(rows), ["event_id"], "60 days")
    q = out.writeStream.format("parquet").option("path", f"{_scratch(spark)}/{name}").option("checkpointLocation", f"{_scratch(spark)}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{_scratch(spark)}/{name}").select("event_id", "event_type")


def stream_sliding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of each account's last day, by state."""
    from ledgerwatch.streaming.pipeline import sliding_stats

    name, e = f"sliding_{datetime.now():%H%M%S%f}", spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(e).format("parquet").load(_stream_copy(spark, sf_dir))
    rows = s.select("event_id", F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 50, 2).alias("amount"), F.get_json_object("props", "$.k").alias("counterparty"))
    out = sliding_stats(rows, 86_400, "60 days")
    q = out.writeStream.format("parquet").option("path", f"{_scratch(spark)}/{name}").option("checkpointLocation", f"{_scratch(spark)}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{_scratch(spark)}/{name}").select("account_id", "event_id", "n", F.round("total", 2).alias("total"), "counterparties")


def _scratch(spark: SparkSession) -> str:
    """A folder for streams' results."""
    return f"{shared_dir(spark)}/streams"


def _stream_copy(spark: SparkSession, sf_dir: str) -> str:
    """Events as a folder of files, as a stream source wants one."""
    path = f"{_scratch(spark)}/events-{datetime.now():%H%M%S%f}"
    table(spark, sf_dir, "events").write.parquet(path)
    return path


QUERIES: dict[str, Query] = {
    "high_value_alerts": _hits_of(rules.HIGH_VALUE), "keyword_alerts": _hits_of(rules.KEYWORD), "high_risk_country_alerts": _hits_of(rules.COUNTRY),
    "rapid_velocity": _hits_of(rules.VELOCITY), "geo_mismatch": _hits_of(rules.GEO), "structuring": _hits_of(rules.STRUCTURING),
} | {f.__name__: f for f in (
    rule_pack_alerts, risk_scores, risk_band_counts, stateless_scores, score_v2_profiles, temporal_decay, customer_risk_profile, ingest_normalize,
    ingest_rejects, external_id, ingest_dedup, insert_if_absent, build_edges, edge_upsert, ring_signal, ring_alerts, account_projection, graph_nodes,
    account_neighbourhood, common_owners, ownership_links, ownership_chain, khop_subgraph, shortest_path, simple_paths, money_flow_edges, label_propagation, louvain_communities,
    connected_components, suspicious_communities, fuzzy_levenshtein, fuzzy_jaro_winkler, phonetic_match, name_screening, pep_screening, feature_matrix,
    online_features, anomaly_scores, tune_thresholds, tune_velocity, kpi_summary, kpi_by_severity, kpi_by_disposition, kpi_trend, kpi_backlog,
    kpi_top_rules, overdue_cases, timeline_metrics, sar_rollup, sar_flat, chain_verify, audit_summary, alerts_page, case_view, case_moves, run_bundle,
    dashboard, stream_dedup, stream_sliding_stats, money_trace, screening_alerts, keyword_screening, transactions_in_context, alerts_between,
    ingest_counts, redacted_lines, planted_patterns,
)}
