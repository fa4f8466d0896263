"""Tables as Parquet folders: append, replace and upsert with a swap of versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.schemas import TABLES


class Store:
    """Tables below a folder that all executors share. Each write makes a new version; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.root}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(str(p)).first()[0]

    def read(self, name: str) -> DataFrame:
        """The table; empty with its schema where nothing has been written. Columns that older files lack are null."""
        version = self._current(name)
        schema = TABLES.get(name)
        if version is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, df: DataFrame) -> None:
        """df becomes the table; readers see the old version until the new one is complete."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        fs, p = self._fs(f"{self.root}/{name}/CURRENT")
        out = fs.create(p, True)
        out.write(bytearray(version.encode()))
        out.close()

    def append(self, name: str, df: DataFrame) -> None:
        version = self._current(name)
        if version is None:
            self.replace(name, df)
        else:
            df.write.mode("append").parquet(f"{self.root}/{name}/{version}")

    def upsert(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Rows of df take the place of those with their key."""
        old = self.read(name)
        kept = old.join(df.select(*key), key, "left_anti")
        self.replace(name, kept.unionByName(df, allowMissingColumns=True).select(*old.columns))

    def counts(self) -> dict[str, int]:
        return {n: self.read(n).agg(F.count(F.lit(1))).first()[0] for n in TABLES}
