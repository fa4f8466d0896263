"""Sanctions and PEP lists as one table: entry_id, name, aliases, kind, source, country, risk_level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.text import stripped

#: Columns of a headerless SDN file by place.
SDN_PLACES = {"ent_num": 0, "sdn_name": 1, "sdn_type": 2, "program": 3, "title": 4, "remarks": 11}


def _aliases(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), r"\|"), lambda a: stripped(a)), lambda a: a.isNotNull())


def _entries(df: DataFrame, **of: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.xxhash64(*df.columns).alias("entry_id"), stripped(of["name"]).alias("name"), of.get("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(stripped(of.get("entity_type", none)), F.lit("individual")).alias("entity_type"),
        F.coalesce(stripped(of.get("source", none)), F.lit("custom")).alias("source"), stripped(of.get("country", none)).alias("country"),
        stripped(of.get("list_date", none)).alias("list_date"), F.coalesce(stripped(of.get("risk_level", none)), F.lit("high")).alias("risk_level"),
        of.get("extra", F.create_map().cast("map<string,string>")).alias("extra"),
    ).where("name is not null")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list with a header, as CSV (aliases split at |) or JSON (an array of objects)."""
    if path.endswith(".json"):
        df = spark.read.option("multiLine", True).json(path)
    else:
        df = spark.read.option("header", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    has = {n: F.col(n) for n in ("name", "entity_type", "source", "country", "list_date", "risk_level") if n in df.columns}
    if "aliases" in df.columns:
        listed = df.schema["aliases"].dataType.typeName() == "array"
        has["aliases"] = F.transform("aliases", lambda a: a.cast("string")) if listed else _aliases(F.col("aliases"))
    more = [c for c in df.columns if c not in (*has, "aliases")]
    if more:
        has["extra"] = F.create_map(*[x for c in more for x in (F.lit(c), F.col(c).cast("string"))])
    return _entries(df, **has)


def read_sdn(spark: SparkSession, path: str) -> DataFrame:
    """An SDN file, with its header or by place; -0- stands for no value."""
    raw = spark.read.option("escape", '"').csv(path)
    head = [str(v or "").strip().lower() for v in raw.first()]
    headed = "sdn_name" in head or "ent_num" in head
    if headed:
        df = spark.read.option("header", True).option("escape", '"').csv(path)
        df = df.toDF(*[c.strip().lower() for c in df.columns])
        col = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    else:
        df = raw
        col = lambda n: F.col(raw.columns[SDN_PLACES[n]]) if n in SDN_PLACES and SDN_PLACES[n] < len(raw.columns) else F.lit(None).cast("string")
    value = lambda n: F.nullif(stripped(col(n)), F.lit("-0-"))
    kind = value("sdn_type")
    if not headed:
        kind = F.when(stripped(col("sdn_type")) == "-0-", "organization").otherwise(kind)
    extra = F.create_map(*[x for n in ("program", "title", "remarks") for x in (F.lit(n), value(n))])
    return _entries(
        df, name=value("sdn_name"), entity_type=kind, source=F.lit("OFAC_SDN"), country=value("country"), aliases=_aliases(value("aliases")), extra=extra
    )


def read_pep(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    col = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    return _entries(
        df, name=col("name"), country=col("country"), risk_level=col("risk_level"), source=F.coalesce(stripped(col("source")), F.lit("PEP")),
        aliases=_aliases(col("aliases")), extra=F.create_map(F.lit("position"), col("position")),
    )


def status(entries: DataFrame) -> DataFrame:
    """Entries and aliases by source."""
    return entries.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("aliases")).alias("aliases"))
