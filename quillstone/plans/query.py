"""Table queries: conjunctive filters in text form, projection, order, cursor and limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import all_of, any_of, project

MODES = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "rg")
DEFAULT_LIMIT, MAX_LIMIT = 500, 5000


def condition(column: Column, mode: str, value: str, kind: str, scale: int = 1) -> Column:
    """One filter. Lists and ranges are separated by commas; an empty list matches nothing. ``scale`` multiplies literals."""

    def literal(text: str) -> Column:
        if scale != 1:
            return F.lit(int((Decimal(text) * scale).to_integral_value(ROUND_HALF_EVEN))).cast("bigint")
        return F.lit(text).cast(kind)

    if mode not in MODES:
        raise ValueError(f"unknown filter mode {mode}")
    parts = [x for x in value.split(",") if x]
    if mode in ("in", "nin"):
        found = column.isin(*map(literal, parts)) if parts else F.lit(False)
        return found if mode == "in" else ~found
    if mode == "rg":
        if len(parts) != 2:
            raise ValueError("a range has two ends")
        return column.between(*map(literal, parts))
    x = literal(value)
    return {"eq": column == x, "ne": column != x, "gt": column > x, "gte": column >= x, "lt": column < x, "lte": column <= x}[mode]


@dataclass(frozen=True)
class TableQuery:
    """``filters``: (column or column.mode, value) pairs, all of which must hold; ``any_party`` names columns of which one must match."""

    columns: tuple[str, ...]
    filters: tuple[tuple[str, str], ...] = ()
    aliases: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    any_party: dict = field(default_factory=dict)
    key: tuple[str, ...] = ()
    cursor: tuple = ()
    offset: int = 0
    limit: int | None = None
    descending: bool = False

    def conditions(self, df: DataFrame) -> list[Column]:
        kinds = dict(df.dtypes)
        out = []
        for name, value in self.filters:
            column, _, mode = name.partition(".")
            mode = mode or "eq"
            if column in self.any_party:
                sides = [condition(F.col(c), mode, value, kinds[c]) for c in self.any_party[column]]
                out.append(all_of(sides) if mode in ("ne", "nin") else any_of(sides))
                continue
            stored = self.aliases.get(column, column)
            if stored not in kinds:
                raise ValueError(f"unknown column {column}")
            out.append(condition(F.col(stored), mode, value, kinds[stored], self.scales.get(column, 1)))
        return out

    def after_cursor(self) -> Column:
        """Rows beyond the cursor in key order: the first key differs, or it is equal and the next differs, and so on."""
        out, equal = F.lit(False), F.lit(True)
        for name, value in zip(self.key, self.cursor, strict=True):
            c = F.col(name)
            out = out | (equal & (c < value if self.descending else c > value))
            equal = equal & (c == value)
        return out

    def run(self, df: DataFrame) -> DataFrame:
        found = df.where(all_of(self.conditions(df)))
        if self.cursor:
            found = found.where(self.after_cursor())
        if self.key:
            found = found.orderBy(*(F.desc(k) if self.descending else F.asc(k) for k in self.key))
        if self.key or self.limit is not None or self.offset:
            found = found.offset(0 if self.cursor else self.offset).limit(min(self.limit or DEFAULT_LIMIT, MAX_LIMIT))
        return project(found, list(self.columns), self.aliases)
