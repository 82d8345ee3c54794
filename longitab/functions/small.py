"""Joins that broadcast only what was measured to be small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SMALL_ROWS = 100_000


class NotSmall(ValueError):
    """A table that must stay small (classes, features) has too many rows."""


def head(df: DataFrame, max_rows: int = MAX_SMALL_ROWS):
    """All rows of ``df`` as a local table, or None when there are more than ``max_rows``."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def small_table(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """``df`` evaluated once and kept as local rows; raises when it is not small."""
    table = head(df, max_rows)
    if table is None:
        raise NotSmall(f"more than {max_rows} rows in a table of {df.columns}")
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def small_rows(df: DataFrame, max_rows: int = MAX_SMALL_ROWS) -> list[dict]:
    """Rows of a small table as dictionaries; raises when it is not small."""
    table = head(df, max_rows)
    if table is None:
        raise NotSmall(f"more than {max_rows} rows in a table of {df.columns}")
    return table.to_pylist()


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               max_rows: int = MAX_SMALL_ROWS) -> DataFrame:
    """Join against a table that is expected, but not known, to be small.

    Up to ``max_rows`` rows it is evaluated once and broadcast. Beyond that the join is left
    to Spark, where adaptive execution splits skewed shuffle partitions.
    """
    table = head(small, max_rows)
    if table is None:
        return join_null_safe(big, small, on, how)
    local = big.sparkSession.createDataFrame(table, schema=small.schema)
    return join_null_safe(big, F.broadcast(local), on, how)


def join_null_safe(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``inner`` or ``left`` join by name in which a null key equals a null key."""
    other = small.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = reduce(Column.__and__, [big[c].eqNullSafe(other[f"_of_{c}"]) for c in on])
    return big.join(other, same, how).drop(*[f"_of_{c}" for c in on])
