"""Column expressions and small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of a batch that is sent to Python, besides its last row.
BATCH_BYTES = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's switch to remove an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't white space; empty for a null text."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; the fast path needs no character table."""
    t = whole(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, _UPPER, _UPPER.lower())
    )


def shingle_hashes(words_col: str, n: int, short_whole: bool = True) -> Column:
    """64-bit hashes of all runs of n words, repeats included.

    words_col must be a column, not an expression, as each run refers to it. With
    fewer than n words the whole sequence is the one shingle if short_whole.
    """
    w = F.col(words_col)
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - n),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]),
    )
    few = F.array().cast("array<bigint>")
    if short_whole:
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.lit(-1), w))).otherwise(few)
    return F.when(F.size(w) >= n, runs).otherwise(few)


def pinned(c: Column) -> Column:
    """The column, in a form that keeps filters on it above its projection.

    Pushed below, a filter would put whole expressions in place of columns, also
    inside lambdas that look up their neighbours, and so work out an array once for
    each of its elements.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine takes a local folder, and any other
    the warehouse, which a cluster shares too.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            there = f"file://{tempfile.mkdtemp(prefix='ledgerwatch-')}"
        else:
            there = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are cut at BATCH_BYTES too, unless the session says otherwise."""
    if spark.conf.get(_BATCH, None) in (None, "", str(2**31 - 1)):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: its lineage ends there.

    The files outlive lost executors. They go when the driver's JVM ends. The shuffle
    files behind df are of no more use once it is written, and Spark is told so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerwatch/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
