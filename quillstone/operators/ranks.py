"""Ranks, groups and running totals that no single task need hold."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set an own one, if all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path or tempfile.mkdtemp(prefix="quillstone-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running totals over all rows in ``order``: per range of the order, then over the ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).withColumns({f"__{n}": c for n, c in sums.items()}))
    totals = ranged.groupBy("__part").agg(*(F.sum(f"__{n}").alias(f"__{n}_t") for n in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select("__part", *(F.coalesce(F.sum(f"__{n}_t").over(before), F.lit(0)).alias(f"__{n}_b") for n in sums))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(f"__{n}").over(within) for n in sums}).join(F.broadcast(bases), "__part")
    return out.select(*df.columns, *((F.col(n) + F.col(f"__{n}_b")).alias(n) for n in sums))


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``rank``: by falling value, ties by key; a row ranks one more than the dense rank of the row before.

    Dense ranks are counted over distinct values; within a value only the first row still has the rank of the values before. Rows
    with value zero or null have no rank. The join on the value is split by adaptive execution where very many rows tie.
    """
    firsts = df.where(F.col(value) != 0).groupBy(value).agg(F.min(key).alias("__first"))
    dims = running(firsts, [F.desc(value)], {"dense": F.lit(1).cast("bigint")})
    rank = F.when(F.col("dense") == 1, F.when(F.col(key) == F.col("__first"), 1).otherwise(2)).otherwise(F.when(F.col(key) == F.col("__first"), F.col("dense")).otherwise(F.col("dense") + 1))
    return df.join(dims, value, "left").select(*df.columns, rank.cast("bigint").alias("rank"))


def top(df: DataFrame, by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows: a top-k of offset + limit rows a task, then one."""
    return df.orderBy(*by).offset(offset).limit(limit)


def group_page(df: DataFrame, group: list[str], limit: int, offset: int = 0) -> DataFrame:
    """All rows of the groups ``offset`` .. ``offset + limit`` in the groups' order: the page counts groups."""
    page = df.select(*group).distinct().orderBy(*group).offset(offset).limit(limit)
    return df.join(page, group, "left_semi")
