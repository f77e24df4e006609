from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, finish_columns, partial_columns
from frostgrid.functions.time import floor_div, from_micros, micros, step_micros
from frostgrid.operators.runs import merge_runs

CHUNK_CELLS = 65_536


def sessionize(
    df: DataFrame,
    ts: str,
    keys: list[str],
    gap: str,
    aggs: dict[str, Agg],
    chunk_cells: int = CHUNK_CELLS,
) -> DataFrame:
    """Merge the events of a key into sessions.

    A new session starts when the silence is longer than ``gap``; events
    exactly ``gap`` apart stay together. Returns the keys, ``session_start``,
    ``session_end`` (last event plus ``gap``) and the given aggregates.

    Two events of a key in the same ``gap``-wide cell of time always share a
    session, so events are first reduced to one row per key and cell on the
    map side. What is left per key is bounded by time, not by events; a key
    with a third of all events needs no special care. (``F.session_window``
    would sort all events of a key in one task.)
    """
    width = step_micros(gap)
    time = F.col("__us")
    cells = (
        df.where(F.col(ts).isNotNull())
        .withColumn("__us", micros(df, ts))
        .groupBy(*keys, floor_div(time, width).alias("__cell"))
        .agg(F.min(time).alias("__start"), F.max(time).alias("__end"), *partial_columns(aggs))
        .drop("__cell")
    )
    runs = merge_runs(cells, keys, "__start", "__end", width, width * chunk_cells, aggs, reduced=True)
    dtype = df.schema[ts].dataType
    return runs.select(
        *keys,
        from_micros(F.col("__start"), dtype).alias("session_start"),
        from_micros(F.col("__end") + width, dtype).alias("session_end"),
        *finish_columns(aggs),
    )
