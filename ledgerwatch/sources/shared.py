"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder on one machine and else one below the warehouse."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            there = f"file://{tempfile.mkdtemp(prefix='ledgerwatch-')}"
        else:
            there = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Makes checkpoint() write to the shared folder where nothing has been set for it yet."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))


def ranged(df: DataFrame, order: str, part: str = "__p") -> DataFrame:
    """df dealt into ranges of order, and the number of each row's range, rising with order.

    It is written to the shared folder: plans that read it twice see the same ranges, whatever
    is run again or merged by adaptive execution.
    """
    ready_to_checkpoint(df.sparkSession)
    return df.repartitionByRange(order).withColumn(part, F.spark_partition_id()).checkpoint()
