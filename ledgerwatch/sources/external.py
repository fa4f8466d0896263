"""Databases and Kafka by Spark's own connectors, whose drivers the cluster brings along."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table. With a numeric key it is read in parts between the key's ends; filters and columns go to the database."""
    reader = lambda t: spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", t)
    if key is None:
        return reader(table).load()
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = reader(f"(SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}) ends").load().first()
    if low is None:
        return reader(table).load()
    return reader(table).options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 16, **options: str) -> None:
    """Rows to a database table, over parts connections at most. Each part is one transaction, so a key must guard against a task that runs twice."""
    df.write.format("jdbc").options(**options).option("url", url).option("dbtable", table).option("numPartitions", parts).mode(mode).save()


def messages(rows: DataFrame, key: str = "account_id") -> DataFrame:
    """key and value (the row as JSON) as Kafka takes them; rows of an account stay in order."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def publish(rows: DataFrame, servers: str, topic: str, key: str = "account_id", **options: str) -> None:
    """Rows as messages of a Kafka topic."""
    messages(rows, key).write.format("kafka").options(**options).option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def consume(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """A stream of a topic's messages as rows; offsets are kept by the query's checkpoint, so no message is lost or taken twice."""
    raw = spark.readStream.format("kafka").options(**options).option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).where("m is not null").select("m.*")


def replay(spark: SparkSession, folder: str, target: Mapping[str, str], files: int = 1, every: str = "1 second") -> StreamingQuery:
    """Plays a folder of text files into another one, files at a time, one batch every interval: {path, checkpoint}."""
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder)
    out = rows.writeStream.format("text").option("path", target["path"]).option("checkpointLocation", target["checkpoint"])
    return out.trigger(processingTime=every).start()
