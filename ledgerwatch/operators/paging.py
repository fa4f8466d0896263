"""Keyset pages, point lookups and field checks."""

from __future__ import annotations

import base64
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 1000


def encode_cursor(id_: int) -> str:
    return base64.urlsafe_b64encode(str(id_).encode()).decode()


def decode_cursor(cursor: str | None) -> int | None:
    """The id of a cursor; None without one, ValueError for one that isn't ours."""
    if not cursor:
        return None
    try:
        return int(base64.urlsafe_b64decode(cursor.encode()).decode())
    except Exception as e:
        raise ValueError("not a cursor") from e


def page(df: DataFrame, limit: int = 100, cursor: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows behind the cursor, at most limit (1 to MAX_PAGE) and one more that tells of a next page."""
    after = decode_cursor(cursor)
    rows = df if after is None else df.where(F.col(id_col) > after)
    return rows.orderBy(id_col).limit(max(1, min(limit, MAX_PAGE)) + 1)


def next_cursor(rows: list, limit: int, id_col: str = "id") -> tuple[list, str | None]:
    """The page's rows and the cursor of the next one, or None."""
    limit = max(1, min(limit, MAX_PAGE))
    return (rows[:limit], encode_cursor(rows[limit - 1][id_col])) if len(rows) > limit else (rows, None)


def equal_to(df: DataFrame, **values) -> DataFrame:
    """Rows with these values; a value of None asks for nothing."""
    for k, v in values.items():
        if v is not None:
            df = df.where(F.col(k) == v)
    return df


def between(df: DataFrame, col: str, start: Column | datetime | None = None, end: Column | datetime | None = None) -> DataFrame:
    """Rows from start to end, both included; an end of None is open."""
    if start is not None:
        df = df.where(F.col(col) >= start)
    return df if end is None else df.where(F.col(col) <= end)


def find(df: DataFrame, id_: int, id_col: str = "id"):
    """The row of an id; KeyError without one."""
    row = df.where(F.col(id_col) == id_).first()
    if row is None:
        raise KeyError(id_)
    return row


def with_children(parents: DataFrame, children: Mapping[str, tuple[DataFrame, str]], id_col: str = "id") -> DataFrame:
    """Parents with an array of each kind of children: {name: (rows, key)}; empty where there are none."""
    out = parents
    for name, (rows, key) in children.items():
        kids = rows.groupBy(F.col(key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        out = out.join(kids, F.col(id_col) == F.col("__k"), "left").drop("__k")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kids.schema[name].dataType)))
    return out


def valid_transactions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows within the field limits, and the others."""
    good = (
        (F.abs("amount") <= 1e12) & (F.char_length("currency") == 3)
        & (F.col("country").isNull() | F.char_length("country").between(2, 3)) & (F.col("direction").isNull() | F.col("direction").isin("in", "out"))
    )
    good = F.coalesce(good, F.lit(False))
    return df.where(good), df.where(~good)
