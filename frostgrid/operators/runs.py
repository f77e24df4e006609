"""Merging of neighbouring segments into runs, shared by spells and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, merge_columns, partial_columns
from frostgrid.functions.time import floor_div


def merge_runs(
    segments: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    max_gap: int,
    chunk_width: int,
    aggs: dict[str, Agg],
    reduced: bool,
) -> DataFrame:
    """Join segments of a key while ``next start - previous end <= max_gap``.

    ``start`` and ``end`` are whole numbers, segments of a key do not overlap,
    and none crosses a multiple of ``chunk_width``. Runs are first formed
    inside chunks of that width, which bounds what one task sorts. Only a run
    within ``max_gap`` of its chunk's border can go on next door: at most two
    per key and chunk. A second pass reads those of a key together; the other
    runs stay with their chunk and pass through it unchanged.

    ``reduced`` says whether the segments already hold the partial states of
    ``aggs`` or the raw columns. The result holds partial states.
    """
    chunked = segments.withColumn("__chunk", floor_div(F.col(start), chunk_width))
    states = merge_columns(aggs) if reduced else partial_columns(aggs)
    local = _merge_sorted(chunked, [*keys, "__chunk"], start, end, max_gap, states)
    opens = F.col("__chunk") * chunk_width
    at_border = (F.col(start) - opens + 1 <= max_gap) | (opens + chunk_width - F.col(end) <= max_gap)
    placed = local.withColumn("__chunk", F.when(~at_border, F.col("__chunk")))
    return _merge_sorted(placed, [*keys, "__chunk"], start, end, max_gap, merge_columns(aggs)).drop("__chunk")


def _merge_sorted(
    segments: DataFrame, group: list[str], start: str, end: str, max_gap: int, states: list[Column]
) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(start, end)
    begins = F.coalesce(F.col(start) - F.lag(end).over(w) > max_gap, F.lit(True))
    return (
        segments.withColumn("__begins", begins.cast("bigint"))
        .withColumn("__run", F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "__run")
        .agg(F.min(start).alias(start), F.max(end).alias(end), *states)
        .drop("__run")
    )
