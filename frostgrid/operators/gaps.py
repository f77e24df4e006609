from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.functions.time import floor_div, from_micros, micros, step_micros

CHUNK_STEPS = 65_536


def gap_fill(
    df: DataFrame,
    ts: str,
    keys: list[str],
    step: str,
    method: str = "null",
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """Every step of the grid from the first to the last row of each key.

    ``df`` has one row per key and step, as :func:`resample` returns it. Added
    steps are null (``method="null"``), or every null is replaced by the last
    value before it (``method="last"``).

    Each row emits the missing steps that follow it, so only rows that exist
    are shuffled, once. Keys are cut into chunks of ``chunk_steps`` steps: no
    task sorts more rows of one key than that. Gaps that reach across chunks
    are filled from a table with one row per key and chunk, made from the same
    shuffled rows, and are emitted in pieces that are spread anew.
    """
    if method not in ("null", "last"):
        raise ValueError(f"unknown method: {method!r}")
    carry = method == "last"
    width = step_micros(step)
    values = [c for c in df.columns if c not in (*keys, ts)]
    step_col, next_col, at = F.col("__step"), F.col("__next"), F.col("__at")

    rows = (
        df.where(F.col(ts).isNotNull())
        .select(*keys, floor_div(micros(df, ts), width).alias("__step"), *values)
        .withColumn("__chunk", floor_div(step_col, chunk_steps))
        .repartition(*keys, "__chunk")
    )
    chunks = rows.groupBy(*keys, "__chunk").agg(
        F.min(step_col).alias("__first"),
        F.max(step_col).alias("__step"),
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), step_col) if carry else step_col).alias(v)
            for v in values
        ],
    )
    in_chunk = Window.partitionBy(*keys, "__chunk").orderBy(step_col.asc_nulls_first())
    by_chunk = Window.partitionBy(*keys).orderBy("__chunk")

    def kept(v: str, window, upto: int = 0):
        if not carry:
            return F.col(v)
        return F.last(v, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, upto)).alias(v)

    def emitted(v: str):
        return F.col(v) if carry else F.when(at == step_col, F.col(v)).alias(v)

    if carry:
        # A row without a step opens each chunk with the values known before it.
        opening = chunks.select(
            *keys, F.lit(None).cast("bigint").alias("__step"), "__chunk", *[kept(v, by_chunk, -1) for v in values]
        )
        rows = rows.unionByName(opening.repartition(*keys, "__chunk"))

    within = (
        rows.select(
            *keys, step_col, F.lead(step_col).over(in_chunk).alias("__next"), *[kept(v, in_chunk) for v in values]
        )
        .where(step_col.isNotNull())
        .withColumn("__upto", F.greatest(step_col, F.coalesce(next_col - 1, step_col)))
        .withColumn("__at", F.explode(F.sequence("__step", "__upto")))
    )
    pieces = (
        chunks.select(
            *keys, step_col, F.lead("__first").over(by_chunk).alias("__next"), *[kept(v, by_chunk) for v in values]
        )
        .where(next_col > step_col + 1)
        .withColumn("__from", F.explode(F.sequence(step_col + 1, next_col - 1, F.lit(chunk_steps).cast("bigint"))))
        .repartition(*keys, "__from")
    )
    across = pieces.withColumn(
        "__at", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + chunk_steps, next_col) - 1))
    )
    grid = [*keys, at, *[emitted(v) for v in values]]
    time = from_micros(at * width, df.schema[ts].dataType).alias(ts)
    return within.select(*grid).unionByName(across.select(*grid)).select(
        *[time if c == ts else c for c in df.columns]
    )
