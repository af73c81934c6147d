"""Per-block, per-epoch and per-account aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_rollup(ops: DataFrame) -> DataFrame:
    """A row for each height: counts and sums by the kind of operation, in one aggregate."""
    micro = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    back = F.col("l_returnflag") == "R"
    return ops.groupBy(F.col("l_orderkey").alias("height")).agg(
        F.count("*").alias("n_ops"),
        F.count_if(back).alias("n_returns"),
        F.sum(F.when(~back, micro("l_extendedprice")).otherwise(0)).alias("volume"),
        F.sum(micro("l_tax")).alias("fee"),
        F.bool_or(F.col("l_linestatus") == "O").alias("has_open"),
    )


def epochs(blocks: DataFrame, height: str, value: str, width: int) -> DataFrame:
    """Least, most and sum of ``value`` for each epoch of ``width`` heights, and the earliest heights that have them."""
    h, v = F.col(height), F.col(value)
    return blocks.groupBy(F.expr(f"{height} div {width}").alias("cycle")).agg(
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        F.sum(v).alias("v_sum"),
        F.min(h).alias("first_height"),
        F.max(h).alias("last_height"),
        F.max_by(h, F.struct(v, -h)).alias("best_height"),
        F.min_by(h, F.struct(v, h)).alias("worst_height"),
    )


def income(legs: DataFrame) -> DataFrame:
    """cycle, account and signed sums of its legs (kind, amount)."""
    of = lambda kind, sign=1: F.when(F.col("kind") == kind, F.col("amount") * sign).otherwise(0)
    return legs.groupBy("cycle", "account").agg(
        F.sum(of("signup")).alias("deposit"),
        F.sum(of("purchase")).alias("reward"),
        F.sum(of("error", -1)).alias("lost"),
        F.sum(of("signup") + of("purchase") + of("error", -1)).alias("total"),
    )


def luck(rows: DataFrame) -> DataFrame:
    """expected: an account's share by stake of what its cycle earned, in thousandths; luck: 10000 is as expected.

    A cycle's totals are aggregated first and joined, so no task holds a whole cycle.
    """
    totals = rows.groupBy("cycle").agg(F.sum("stake").alias("all_stake"), F.sum("earned").alias("all_earned"))
    out = rows.join(totals, "cycle").withColumn("expected", F.expr("(stake * all_earned * 1000) div all_stake"))
    share = (F.col("earned") * 1000 - F.col("expected")) * 10000 / F.col("expected")
    return out.select("cycle", "account", "expected", F.when(F.col("expected") > 0, 10000 + share).alias("luck"))


def health(blocks: DataFrame, slots: int, depth: int = 127) -> DataFrame:
    """100 less what the last blocks' rounds and missed slots weigh, newer ones more; never below 0."""
    last = blocks.orderBy(F.desc("height")).limit(depth)
    age = F.row_number().over(Window.orderBy(F.desc("height")))  # of ``depth`` rows
    weighed = last.withColumn("age", age).select(((2 * F.col("round") + F.col("missed") * 50 / slots) / F.col("age")).alias("w"))
    return weighed.agg(F.greatest(F.lit(0.0), F.round(100 - F.sum("w"), 6)).alias("health"))


def trees(ops: DataFrame) -> DataFrame:
    """The operations of a height as one container: how many, their volume, their numbers in order."""
    each = F.transform(F.array_sort(F.collect_list("op_n")), lambda x: x.cast("string"))
    return ops.groupBy("height").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.concat_ws(",", each).alias("members"))
