"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents,
and returns a DataFrame. run() writes each stage's result as Parquet below the
shared folder and gives the next stage what it reads back. All but the last
stage return the columns of documents.

Ids may be null or repeated: stages that decide by id decide by id and text
together, so two texts of one id don't share a verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_scan
from ledgerwatch.llm.common import whole, written

#: Near copies: five-word shingles and a similarity of 0.8.
NEAR = jaccard_join.Measure(n=5, num=80, den=100)
#: A side of a join is broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__text"))
    return quality_rules.apply_rules(rows, "__text", ["__doc"]).where("kept").select("__doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one of the least id, null ids last; texts without words all stay.

    A row is known by the hash of its id and text; of rows equal in both, any one stays.
    The texts move once at most: rows that go are few beside all, and their hashes are
    broadcast while they are.
    """
    row = F.xxhash64("doc_id", "text")
    found = jaccard_join.join(docs.withColumn("__row", row), NEAR, id_col="__row").where("n_shingles > 0")
    # Ids of rows are unique and never null, so component_id names one component.
    found = found.groupBy("__row").agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("n"))
    ids = docs.select("doc_id", row.alias("__row")).distinct()
    found = written(found.join(ids, "__row"), "pipeline-rows")
    least = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("stays"), F.sum("n").alias("rows"))
    rows = found.join(least.where("rows > 1"), "group").select("__row", (F.col("__row") == F.col("stays")).alias("stays"), "n")
    marked = written(rows.where("not stays or n > 1").select("__row", "stays"), "pipeline-copies")
    side = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    keyed = docs.withColumn("__row", row)
    out = keyed.join(side, "__row", "left_anti")
    if marked.where("stays").limit(1).count():
        out = out.unionByName(keyed.join(side.where("stays"), "__row", "left_semi").dropDuplicates(["__row"]))
    return out.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_hash="__text")
    return decontaminate.without_leaks(docs, found, text_hash="__text").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the spans of secrets in their texts replaced by their kind; n_chars follows."""
    keyed = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("__hash"))
    found = secret_scan.find(keyed, keep=["doc_id", "__hash"], repo_col="source")
    found = found.where(F.size("spans") > 0).groupBy("doc_id", "__hash").agg(F.first("spans").alias("__spans"))
    found = written(found, "pipeline-secrets").withColumnsRenamed({"doc_id": "__d", "__hash": "__h2"})
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    both = docs.join(side, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__h2")), "left")
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(secret_scan.redacted(whole(F.col("text")), F.col("__spans")))
    out = both.withColumn("text", clean)
    size = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", size).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("decontaminate", decontaminated),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]

#: Permutations of the last stage and components of the second aren't stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
