"""Aggregates with a small state that can be merged.

The operators accept only these, so a group of any size is reduced on the map
side before anything is shuffled, and partial results can be merged again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    kind: str
    column: str | None = None

    def whole(self) -> Column:
        """The aggregate over rows, in one step."""
        if self.kind == "count":
            return F.count(F.lit(1))
        return {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[self.kind](self.column)

    def partial(self, name: str) -> list[Column]:
        """State columns over rows; the result needs :meth:`merge` and :meth:`finish`."""
        if self.kind == "mean":
            return [F.sum(self.column).alias(f"{name}__sum"), F.count(self.column).alias(f"{name}__n")]
        return [self.whole().alias(name)]

    def merge(self, name: str) -> list[Column]:
        """State columns over state columns."""
        if self.kind == "mean":
            return [F.sum(part).alias(part) for part in (f"{name}__sum", f"{name}__n")]
        fn = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return [fn(name).alias(name)]

    def finish(self, name: str) -> Column:
        """The final value from state columns."""
        if self.kind == "mean":
            return F.try_divide(F.col(f"{name}__sum"), F.col(f"{name}__n")).alias(name)
        return F.col(name)


def count() -> Agg:
    return Agg("count")


def total(column: str) -> Agg:
    return Agg("sum", column)


def mean(column: str) -> Agg:
    return Agg("mean", column)


def low(column: str) -> Agg:
    return Agg("min", column)


def high(column: str) -> Agg:
    return Agg("max", column)


def partial_columns(aggs: dict[str, Agg]) -> list[Column]:
    return [c for name, agg in aggs.items() for c in agg.partial(name)]


def merge_columns(aggs: dict[str, Agg]) -> list[Column]:
    return [c for name, agg in aggs.items() for c in agg.merge(name)]


def finish_columns(aggs: dict[str, Agg]) -> list[Column]:
    return [agg.finish(name) for name, agg in aggs.items()]


def whole_columns(aggs: dict[str, Agg]) -> list[Column]:
    return [agg.whole().alias(name) for name, agg in aggs.items()]
