import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_sql():
    """Compares a registered query with its SQL on the small data."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def rows(df, cols):
        plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
        return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].itertuples(index=False))

    def compare(spark, query, sql):
        mine, theirs = query(spark, SMALL).toPandas(), con.execute(sql).df()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns)
        assert rows(mine, cols) == rows(theirs, cols)

    return compare
