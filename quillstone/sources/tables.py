"""Scans and lookups over Parquet tables, and text forms of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """The named columns in order; aliases lead from long names to stored ones. Unknown and repeated names are errors."""
    aliases = aliases or {}
    if len(set(columns)) < len(columns):
        raise ValueError("a column is asked for twice")
    for c in columns:
        if aliases.get(c, c) not in df.columns:
            raise ValueError(f"unknown column {c}")
    return df.select(*(F.col(aliases.get(c, c)).alias(c) for c in columns))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The one row with this key, or none."""
    return df.where(F.col(key) == value).limit(1)


def lookup_many(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the first column of ``ids``; repeats there do no harm."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def money(micro: Column) -> Column:
    """Micro-units as a decimal of six places."""
    return (micro.cast("decimal(38,6)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,6)")


def micro(amount: Column) -> Column:
    """An amount as whole micro-units, halves to even."""
    return F.bround(amount * 1_000_000).cast("bigint")


def brief_json(df: DataFrame) -> DataFrame:
    """line: each row as a JSON array in column order; true and false are 1 and 0, missing is null."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            text = c.cast("int").cast("string")
        elif kind == "string":
            text = F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)  # escapes control characters too
        elif kind == "binary":
            text = F.concat(F.lit('"'), F.lower(F.hex(c)), F.lit('"'))
        elif kind.startswith(("timestamp", "date")):
            text = F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
        else:
            text = c.cast("string")
        parts.append(F.when(c.isNull(), "null").otherwise(text))
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("line"))


def verbose_json(df: DataFrame) -> DataFrame:
    """line: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; times as RFC 3339, binary as hex."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind.startswith("timestamp") else F.lower(F.hex(c)) if kind == "binary" else c
        shown.append(c.alias(name))
    df.select(*shown).write.option("header", True).csv(path)


def trailer(page: DataFrame, key: list[str]) -> DataFrame:
    """n_rows and cursor (the largest key, parts separated by commas) of a page of results; one row."""
    return page.agg(F.count("*").alias("n_rows"), F.max(F.struct(*key)).alias("last")).select("n_rows", F.concat_ws(",", *(F.col(f"last.{k}") for k in key)).alias("cursor"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
