"""Ledger files: CSV and JSON lines to canonical rows, rejects, and tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.functions import parsing
from ledgerwatch.functions.text import stripped
from ledgerwatch.sources import columns
from ledgerwatch.sources.shared import ranged

JSON_SCHEMA = ", ".join(f"{f} string" for f in (*columns.FIELDS, "_corrupt_record"))


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multi_line: bool = False) -> DataFrame:
    """All columns as text. Files are read in parts, unless multi_line says that quoted fields span lines."""
    return spark.read.option("header", True).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Canonical fields as text; lines that aren't objects are kept in _corrupt_record."""
    return spark.read.schema(JSON_SCHEMA).option("mode", "PERMISSIVE").option("primitivesAsString", True).json(path)


def discover(spark: SparkSession, path: str, save: bool = False) -> dict[str, str]:
    """The inferred mapping of a CSV or JSON lines file; saved beside it if asked."""
    if path.endswith((".jsonl", ".ndjson", ".json")):
        headers = spark.read.option("primitivesAsString", True).json(path).columns
    else:
        headers = read_csv(spark, path).columns
    out = columns.infer(headers)
    if save:
        columns.save_sidecar(path, out)
    return out


def _field(df: DataFrame, by_field: Mapping[str, str], field: str) -> Column:
    return F.col(f"`{by_field[field]}`").cast("string") if field in by_field else F.lit(None).cast("string")


def normalized(df: DataFrame, mapping: Mapping[str, str], json_lines: bool = False) -> DataFrame:
    """The canonical fields, source_id and reject_reason (null where the row is good) of each row.

    One projection over the scan. JSON lines know fewer time forms, take no id of
    the source, and use the customer's country where the transaction has none.
    """
    by_field = {v: k for k, v in mapping.items()}
    get = lambda f: stripped(_field(df, by_field, f))
    cut = lambda c, n: F.substring(c, 1, n)
    # Parsed once, in a projection that filters on its columns don't pass.
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    time = parsing.json_time(get("ts")) if json_lines else parsing.csv_time(get("ts"))
    number = parsing.amount(_field(df, by_field, "amount"), "minor" in by_field.get("amount", "").lower())
    raw, df = df.columns, df.withColumns({"__ts": once(time), "__amount": once(number)})
    ts, amount = F.col("__ts"), F.col("__amount")
    country = cut(F.coalesce(get("country"), F.lit("XXX")), 3)
    there = get("country_txn") if "country_txn" in by_field else F.lit(None).cast("string")
    own = None if json_lines else columns.id_header(raw)
    source_id = F.lit(None).cast("string") if own is None else stripped(F.col(f"`{own}`"))
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    reason = (
        F.when(bad, "parse_error:JSONDecodeError")
        .when(get("iban_or_acct").isNull(), "missing_iban")
        .when(get("ts").isNull(), "parse_error:ValueError:missing_ts")
        .when(ts.isNull(), F.concat(F.lit("parse_error:ValueError:Cannot parse datetime: "), F.substring(get("ts"), 1, 90)))
        .when(amount.isNull(), "parse_error:ValueError:amount")
    )
    return df.select(
        F.coalesce(get("customer_name"), F.lit("Unknown")).alias("customer_name"), country.alias("country"),
        get("iban_or_acct").alias("iban_or_acct"), ts.alias("ts"), amount.alias("amount"),
        cut(F.coalesce(get("currency"), F.lit("USD")), 3).alias("currency"), get("merchant").alias("merchant"),
        get("counterparty").alias("counterparty"),
        cut(F.coalesce(there, get("country")) if json_lines else there, 3).alias("country_txn"),
        get("channel").alias("channel"), get("direction").alias("direction"),
        parsing.base_risk(_field(df, by_field, "base_risk")).alias("base_risk"),
        F.when(F.char_length(source_id) <= 64, source_id).alias("source_id"), reason.alias("reject_reason"),
    )


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rejected ones with their reason."""
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def reject_summary(rows: DataFrame) -> DataFrame:
    """reason and n over all rejected rows."""
    _, bad = split_rejects(rows)
    kind = F.array_join(F.slice(F.split("reject_reason", ":"), 1, 2), ":")
    return bad.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_rejects(rows: DataFrame, most: int = 500) -> DataFrame:
    """The reasons of the first rejected rows, in the order in which the files are read, most at the utmost."""
    _, bad = split_rejects(rows)
    return bad.select("reject_reason").limit(most)


def ingest_counts(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: rows read, rejected and inserted."""
    read = rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count("reject_reason").alias("rows_rejected"))
    return read.join(F.broadcast(inserted.agg(F.count(F.lit(1)).alias("rows_inserted"))))


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    accounts: DataFrame
    transactions: DataFrame


def identified(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds account_id and external_id: the source's id where it has one, else the hash."""
    known = accounts.select(F.col("id").alias("account_id"), "iban_or_acct")
    hashed = parsing.external_id(F.col("account_id"), F.col("ts"), F.col("amount"), F.col("currency"), F.col("counterparty"), F.col("direction"))
    return rows.join(known, "iban_or_acct").withColumn("external_id", F.coalesce("source_id", hashed))


def first_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def insert_if_absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't in old."""
    return new.join(old.select(key), key, "left_anti")


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Adds a dense id from start + 1 by order, without a single sorting task.

    Rows are ranged by the order; each partition's count shifts the ranks of those behind it.
    """
    parts = ranged(rows, order)
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    out = parts.withColumn("__i", inside).join(F.broadcast(offsets), "__p")
    return out.withColumn("id", (F.col("__i") + F.col("__o") + start).cast("bigint")).drop("__p", "__i", "__o")


def load(rows: DataFrame, before: Tables, now: Column) -> Tables:
    """Tables with good rows added: a customer for each new account, and transactions not yet there.

    Of rows with one account the first one's customer fields win, of rows with one
    external id the first row; the order is that of the time, then of the id.
    """
    rows = rows.withColumn("__seq", F.struct("ts", "amount", "counterparty"))
    new = insert_if_absent(first_wins(rows, "iban_or_acct", [F.col("__seq")]), before.accounts, "iban_or_acct")
    top = before.accounts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(new.select("iban_or_acct", "customer_name", "country", "base_risk"), "iban_or_acct", int(top))
    customers = new.select("id", F.col("customer_name").alias("name"), "country", "base_risk", now.alias("created_at"))
    accounts = new.select("id", F.col("id").alias("customer_id"), "iban_or_acct", now.alias("created_at"))
    all_accounts = before.accounts.unionByName(accounts)
    txns = first_wins(identified(rows, all_accounts), "external_id", [F.col("__seq")])
    txns = insert_if_absent(txns, before.transactions, "external_id")
    last = before.transactions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    txns = numbered(txns.withColumn("country", F.col("country_txn")), "external_id", int(last))
    names = ["id", "external_id", "account_id", "ts", "amount", "currency", "merchant", "counterparty", "country", "channel", "direction"]
    return Tables(
        before.customers.unionByName(customers), all_accounts,
        before.transactions.unionByName(txns.select(*names), allowMissingColumns=True),
    )
