"""Rights as bitmaps: a word of 64 bits for each stretch of positions, so any bitmap stays a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, by: list[str], pos: str, used: str) -> DataFrame:
    """by, word, granted, used: bits of the positions granted, and of those used."""
    bit = F.expr(f"shiftleft(1L, cast({pos} % 64 as int))")
    return rows.groupBy(*by, F.expr(f"{pos} div 64").alias("word")).agg(F.bit_or(bit).alias("granted"), F.bit_or(F.when(F.col(used), bit).otherwise(F.lit(0).cast("bigint"))).alias("used"))


def reliability(maps: DataFrame, by: list[str]) -> DataFrame:
    """Positions granted and used, and their share in ten-thousandths."""
    used = F.bit_count(F.col("granted").bitwiseAND(F.col("used")))
    out = maps.groupBy(*by).agg(F.sum(F.bit_count("granted")).alias("granted"), F.sum(used).alias("used"))
    return out.withColumn("reliability", F.expr("used * 10000 div granted"))


def expanded(maps: DataFrame, column: str = "granted") -> DataFrame:
    """``maps`` with a row for each position whose bit is set: ``pos``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col(column), i) == 1)
    return maps.withColumn("pos", F.explode(bits)).withColumn("pos", F.col("word") * 64 + F.col("pos"))


def absent(maps: DataFrame, by: list[str]) -> DataFrame:
    """by, pos: positions granted but not used."""
    return expanded(maps.withColumn("left", F.col("granted").bitwiseAND(F.bitwise_not("used"))), "left").select(*by, "pos")
