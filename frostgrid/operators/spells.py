from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, finish_columns
from frostgrid.functions.time import floor_div, from_micros, micros, step_micros
from frostgrid.operators.gaps import CHUNK_STEPS
from frostgrid.operators.runs import merge_runs


def threshold_spells(
    df: DataFrame,
    ts: str,
    keys: list[str],
    predicate: Column,
    step: str,
    min_len: int = 1,
    aggs: dict[str, Agg] | None = None,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Longest runs of consecutive grid steps on which ``predicate`` holds.

    Returns the keys, ``spell_start`` and ``spell_end`` (first and last step),
    ``n_steps`` and the given aggregates. A step without a row ends a spell,
    as does a row on which the predicate is null, so the input need not be
    gap-filled. Spells shorter than ``min_len`` steps are left out.

    ``df`` has one row per key and step, as :func:`resample` returns it. Rows
    that fail the predicate are dropped before the one shuffle.
    """
    aggs = aggs or {}
    width = step_micros(step)
    steps = (
        df.where(predicate & F.col(ts).isNotNull())
        .withColumn("__start", floor_div(micros(df, ts), width))
        .withColumn("__end", F.col("__start"))
    )
    runs = merge_runs(steps, keys, "__start", "__end", 1, chunk_steps, aggs, reduced=False)
    n_steps = F.col("__end") - F.col("__start") + 1
    dtype = df.schema[ts].dataType
    return runs.where(n_steps >= min_len).select(
        *keys,
        from_micros(F.col("__start") * width, dtype).alias("spell_start"),
        from_micros(F.col("__end") * width, dtype).alias("spell_end"),
        n_steps.alias("n_steps"),
        *finish_columns(aggs),
    )
