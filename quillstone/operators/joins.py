"""As-of, parent, child and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str], strict: bool = False) -> DataFrame:
    """``left`` with the columns ``value`` of the latest ``right`` row of the same ``by`` and no later ``at``.

    One sort of both sides in place of a range join: the rows of a key go to one place in order, and each left row takes the last
    right one before it. ``strict``: earlier only.
    """
    marks = left.withColumn("__side", F.lit(0 if strict else 1)).withColumn("__right", F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType))
    other = right.select(*by, at, F.lit(1 if strict else 0).alias("__side"), F.struct(*value).alias("__right"))
    both = marks.unionByName(other, allowMissingColumns=True)
    window = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__right", F.last("__right", ignorenulls=True).over(window))
    return both.where(F.col("__side") == (0 if strict else 1)).select(*left.columns, *(F.col(f"__right.{v}").alias(v) for v in value))


def latest(df: DataFrame, by: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The ``values`` of each key's last row; a partial aggregate, so hot keys are combined before the shuffle."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    return best.select(*by, *(F.col(f"__v.{v}").alias(v) for v in values))


def overlapping(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Rows whose closed interval meets [low, high]."""
    return df.where((F.col(end) >= low) & (F.col(start) <= high))


def with_children(parent: DataFrame, child: DataFrame, key: str, order: list[str], values: list[str], name: str = "children") -> DataFrame:
    """``parent`` with an ordered array of its children's ``values`` (empty without any)."""
    rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias(name))
    return parent.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))


def in_range(df: DataFrame, value: str, dim: DataFrame, low: str, high: str) -> DataFrame:
    """``df`` with the columns of the row of ``dim``, a small table of ranges, whose [low, high] holds ``value``; -1 is open."""
    upper = F.when(F.col(high) < 0, F.lit(2**62)).otherwise(F.col(high))
    return df.join(F.broadcast(dim), (F.col(value) >= F.col(low)) & (F.col(value) <= upper), "left")


def fifo(rows: DataFrame, by: str, order: list[str], amount: str, source_id: str) -> DataFrame:
    """by, source, sink, amount: signed amounts matched first in, first out.

    Sources (positive) and sinks (negative) of a key cover intervals of running totals; a transfer is where two overlap. What sinks
    take beyond the sources is minted (source null), what is left over burned (sink null).
    """
    window = Window.partitionBy(by, F.col(amount) > 0).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    some = rows.where(F.col(amount) != 0).withColumn("__to", F.sum(F.abs(amount)).over(window)).withColumn("__from", F.col("__to") - F.abs(amount))
    side = lambda sign, name: some.where(F.col(amount) * sign > 0).select(F.col(by), F.col(source_id).alias(name), F.col("__from").alias(f"{name}_a"), F.col("__to").alias(f"{name}_b"))
    ins, outs = side(1, "source"), side(-1, "sink")
    met = ins.join(outs, by).where((F.col("source_a") < F.col("sink_b")) & (F.col("sink_a") < F.col("source_b")))
    moved = met.select(by, "source", "sink", (F.least("source_b", "sink_b") - F.greatest("source_a", "sink_a")).alias("amount"))
    total = some.groupBy(by).agg(F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0)).alias("__in"), F.sum(F.when(F.col(amount) < 0, -F.col(amount)).otherwise(0)).alias("__out"))
    none = F.lit(None).cast(moved.schema["source"].dataType)
    burnt = ins.join(total, by).where(F.col("source_b") > F.col("__out")).select(by, "source", none.alias("sink"), (F.col("source_b") - F.greatest("source_a", "__out")).alias("amount"))
    minted = outs.join(total, by).where(F.col("sink_b") > F.col("__in")).select(by, none.alias("source"), "sink", (F.col("sink_b") - F.greatest("sink_a", "__in")).alias("amount"))
    return moved.unionByName(burnt).unionByName(minted)
