"""Column expressions shared by the operators."""

from frostgrid.functions.aggregates import Agg, count, high, low, mean, total
from frostgrid.functions.time import floor_div, from_micros, micros, step_micros

__all__ = [
    "Agg", "count", "high", "low", "mean", "total",
    "floor_div", "from_micros", "micros", "step_micros",
]
