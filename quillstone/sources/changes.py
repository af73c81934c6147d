"""Writes: inserts that number rows, deletes by predicate or by key, and versioned copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running


def inserted(table: DataFrame, rows: DataFrame, key: str = "row_id", order: list[Column] | None = None) -> DataFrame:
    """``table`` and ``rows``, which get the numbers after the table's largest in ``order``."""
    last = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("__last"))  # one row
    numbered = running(rows, order or [F.col(c) for c in rows.columns], {"__n": F.lit(1).cast("bigint")})
    numbered = numbered.crossJoin(F.broadcast(last)).withColumn(key, F.col("__last") + F.col("__n")).select(table.columns)
    return table.unionByName(numbered)


def updated(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``rows`` in place of those with the same key."""
    return table.join(rows, key, "left_anti").unionByName(rows)


def deleted(table: DataFrame, gone: Column) -> DataFrame:
    """``table`` without the rows for which ``gone`` holds."""
    return table.where(~F.coalesce(gone, F.lit(False)))


def deleted_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def changed_only(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The rows of a history whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("__b", before).where(~F.col(value).eqNullSafe(F.col("__b"))).drop("__b")


def dump(table: DataFrame, path: str, version: int) -> str:
    """A copy of the table under its version's folder."""
    target = f"{path}/version={version}"
    table.write.mode("overwrite").parquet(target)
    return target
