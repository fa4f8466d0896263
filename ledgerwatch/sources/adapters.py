"""Views of general tables as ledgers, for queries without a bank's own data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions, dense in time: an account per user, three accounts to a customer."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"),
        F.floor(F.col("user_id") / 3).cast("bigint").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 50, 2).alias("amount"), F.lit("USD").alias("currency"),
        F.col("event_type").alias("merchant"), F.concat(F.lit("CP "), k.cast("string")).alias("counterparty"),
        F.concat(F.lit("N"), (k % 25).cast("string")).alias("country"), F.col("event_type").alias("channel"),
        F.when(F.col("event_type").isin("purchase", "click"), "out").otherwise("in").alias("direction"),
        F.when(F.col("user_id") % 3 == 0, 5.0).when(F.col("user_id") % 3 == 1, 15.0).otherwise(25.0).alias("base_risk"),
    )


def ledger_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions between customers and suppliers; for graphs, with a lookback."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("account_id"),
        F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("amount"), F.col("s_name").alias("counterparty"), F.col("p_brand").alias("merchant"),
        F.when(F.col("l_returnflag") == "R", "in").otherwise("out").alias("direction"), F.col("l_partkey").alias("part"),
    )


def ledger_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions between customers and a supplier's part: all of them, and sparse enough for paths."""
    c = F.concat("counterparty", F.lit(" part "), F.col("part").cast("string"))
    return ledger_lineitem(spark, sf_dir).withColumn("counterparty", c)


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions of day grain."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("amount"),
    )


def alerts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each order; severity by priority, disposition by status."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    severity = (
        F.when(p.startswith("1"), "critical").when(p.startswith("2"), "high").when(p.startswith("3"), "medium").otherwise("low")
    )
    disposition = F.when(F.col("o_orderstatus") == "F", "sar").when(F.col("o_orderstatus") == "P", "false_positive")
    created = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("account_id"),
        F.concat(F.lit("Rule"), (F.col("o_orderkey") % 7).cast("string")).alias("rule_id"), severity.alias("severity"),
        F.lit(25.0).alias("score"), disposition.alias("disposition"),
        F.when(disposition.isNull(), "open").otherwise("closed").alias("status"), created.alias("created_at"),
        F.when(disposition.isNotNull(), created + F.make_dt_interval(days=F.pmod("o_orderkey", F.lit(30)).cast("int"))).alias("updated_at"),
        F.col("o_totalprice").alias("amount"),
    )


def cases_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each customer with orders, made from its alerts."""
    a = alerts_of_orders(spark, sf_dir)
    c = a.groupBy(F.col("account_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    status = F.when(F.col("id") % 4 == 0, "CLOSED").when(F.col("id") % 4 == 1, "INVESTIGATING").otherwise("NEW")
    return c.withColumns({"status": status, "priority": F.when(F.col("id") % 3 == 0, "HIGH").otherwise("MEDIUM")})
