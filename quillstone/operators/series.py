"""Calendar time series: collapse into buckets, fill the gaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILLS = ("none", "null", "zero", "last", "linear")
SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}
MONTHS = {"M": 1, "q": 3, "y": 12}


@dataclass(frozen=True)
class Collapse:
    """A bucket's width: so many minutes, hours, days, weeks (from Sunday), months, quarters or years."""

    n: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Collapse:
        found = re.fullmatch(r"(-?\d*)([mhdwMqy])", text)
        if not found:
            raise ValueError(f"no collapse: {text}")
        return cls(abs(int(found[1] or 1)) or 1, found[2])

    def truncate(self, ts: Column) -> Column:
        """The start of the unit that holds ``ts``, without time zone."""
        if self.unit == "w":
            return (F.date_trunc("week", ts + F.expr("interval 1 day")) - F.expr("interval 1 day")).cast("timestamp_ntz")
        name = {"m": "minute", "h": "hour", "d": "day", "M": "month", "q": "quarter", "y": "year"}[self.unit]
        return F.date_trunc(name, ts).cast("timestamp_ntz")

    def step(self) -> str:
        return f"interval {self.n * SECONDS[self.unit]} seconds" if self.unit in SECONDS else f"interval {self.n * MONTHS[self.unit]} months"

    def bucket(self, ts: Column, start: Column) -> Column:
        """The start of the bucket that holds ``ts``; buckets of several units count from ``start``, a unit's start."""
        if self.n == 1:
            return self.truncate(ts)
        if self.unit in SECONDS:
            width = self.n * SECONDS[self.unit]
            gone = F.timestamp_diff("SECOND", start, ts)
            return (start + F.make_dt_interval(secs=(F.floor(gone / width) * width).cast("decimal(18,6)"))).cast("timestamp_ntz")
        width = self.n * MONTHS[self.unit]
        gone = (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start)
        return (start + F.make_ym_interval(months=(F.floor(gone / width) * width).cast("int"))).cast("timestamp_ntz")


def _moved(at: datetime, width: Collapse, n: int) -> datetime:
    """The start of ``at``'s unit, ``n`` buckets on."""
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    if width.unit in MONTHS:
        size = MONTHS[width.unit]
        months = (at.year * 12 + at.month - 1) // size * size + n * width.n * size
        return datetime(months // 12, months % 12 + 1, 1)
    start = {"m": at.replace(second=0, microsecond=0), "h": at.replace(minute=0, second=0, microsecond=0), "d": day, "w": day - timedelta(days=(day.weekday() + 1) % 7)}[width.unit]
    return start + timedelta(seconds=n * width.n * SECONDS[width.unit])


def window_of(collapse: str, start: str | None, end: str | None, now: str, limit: int = 500, longest: timedelta | None = None) -> tuple[str, str]:
    """The window of a series, at bucket boundaries: an end that is given counts whole, one that is missing is ``limit`` buckets away.

    Ends in the wrong order are swapped; nothing lies beyond the bucket of ``now``; a window of more than ``longest`` is an error.
    """
    width, present = Collapse.parse(collapse), datetime.fromisoformat(now)
    low, high = (datetime.fromisoformat(x) if x else None for x in (start, end))
    if low and high:
        low, high = min(low, high), max(low, high)
        low, high = _moved(low, width, 0), _moved(high, width, 1)
    elif low:
        low, high = _moved(low, width, 0), _moved(low, width, limit)
    else:
        last = high or present
        low, high = _moved(last, width, 1 - limit), _moved(last, width, 1)
    high = min(high, _moved(present, width, 1))
    if longest and high - low > longest:
        raise ValueError(f"a series of more than {longest}")
    return low.isoformat(), high.isoformat()


def spine(df: DataFrame, start: Column, end: Column, step: str) -> DataFrame:
    """bucket: all starts in [start, end)."""
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.sequence(start, end, F.expr(step))).alias("bucket")).where(F.col("bucket") < end)


def series(df: DataFrame, time: str, sums: dict[str, Column], collapse: str, start: str, end: str, fill: str = "zero", limit: int | None = None, descending: bool = False) -> DataFrame:
    """bucket and the aggregates ``sums`` of rows in [start, end), with empty buckets filled.

    ``none`` leaves them out, ``null`` has nulls, ``zero`` zeros, ``last`` the values before (null before the first), ``linear`` whole
    numbers on the line between the neighbours (at the edges the only neighbour).
    """
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill}")
    width = Collapse.parse(collapse)
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    first = width.truncate(low)
    rows = df.where((F.col(time) >= low) & (F.col(time) < high))
    found = rows.groupBy(width.bucket(F.col(time), first).alias("bucket")).agg(*(c.alias(n) for n, c in sums.items()))
    if fill != "none":
        found = filled(spine(df, first, high, width.step()).join(found, "bucket", "left"), list(sums), fill)
    found = found.orderBy(F.desc("bucket") if descending else F.asc("bucket"))
    return found.limit(limit) if limit is not None else found


def filled(found: DataFrame, names: list[str], fill: str, by: tuple = ()) -> DataFrame:
    """Fill nulls in ``names`` of a spine (bucket), within the groups ``by``; a window over buckets, whose number the spine bounds."""
    if fill == "zero":
        return found.select(*by, "bucket", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    if fill == "last":
        return found.select(*by, "bucket", *(F.last(n, ignorenulls=True).over(before).alias(n) for n in names))
    if fill != "linear":
        return found
    after = Window.partitionBy(*by).orderBy("bucket").rowsBetween(0, Window.unboundedFollowing)
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("bucket"))
    out = []
    for n in names:
        t = F.when(F.col(n).isNotNull(), at)
        a, ta = F.last(n, ignorenulls=True).over(before), F.last(t, ignorenulls=True).over(before)
        b, tb = F.first(n, ignorenulls=True).over(after), F.first(t, ignorenulls=True).over(after)
        out.append((n, a, ta, b, tb))
    wide = found.select(*by, "bucket", *names, at.alias("__t"), *(x.alias(f"__{n}_{k}") for n, a, ta, b, tb in out for k, x in (("a", a), ("ta", ta), ("b", b), ("tb", tb))))
    shown = []
    for n in names:
        part = f"`__{n}_a` + ((__t - `__{n}_ta`) * (`__{n}_b` - `__{n}_a`)) div nullif(`__{n}_tb` - `__{n}_ta`, 0)"
        shown.append(F.expr(f"coalesce(`{n}`, {part}, `__{n}_a`, `__{n}_b`)").alias(n))
    return wide.select(*by, "bucket", *shown)


def seeded(changes: DataFrame, by: str, time: str, value: str, collapse: str, start: str, end: str) -> DataFrame:
    """by, bucket, value: the last value at the end of each bucket of [start, end), carried forward, seeded with the last before ``start``."""
    width = Collapse.parse(collapse)
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    first = width.truncate(low)
    known = changes.where(F.col(time) < high)
    at = F.when(F.col(time) < first, first).otherwise(width.bucket(F.col(time), first))
    last = known.groupBy(by, at.alias("bucket")).agg(F.max_by(value, time).alias(value))
    whole = known.select(by).distinct().crossJoin(F.broadcast(spine(changes, first, high, width.step())))  # the spine is short
    return filled(whole.join(last, [by, "bucket"], "left"), [value], "last", (by,))
