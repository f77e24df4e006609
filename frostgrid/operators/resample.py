from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, whole_columns

CALENDAR_STEPS = ("month", "quarter", "year")


def resample(df: DataFrame, ts: str, keys: list[str], step: str, aggs: dict[str, Agg]) -> DataFrame:
    """Readings on a fixed grid, one row per key and non-empty bucket.

    Buckets are closed on the left and named by their start, in column ``ts``.
    ``step`` is a fixed length ("15 minutes") or one of the calendar steps
    "month", "quarter" and "year". Rows without a time are left out.

    One shuffle, of partial aggregates: a bucket that holds a large share of
    the rows arrives as one small record per map task.
    """
    if step in CALENDAR_STEPS:
        rows = df.where(F.col(ts).isNotNull())
        bucket = F.trunc(F.col(ts).cast("date"), step).cast(df.schema[ts].dataType)
        return rows.groupBy(*keys, bucket.alias(ts)).agg(*whole_columns(aggs))
    grouped = df.groupBy(*keys, F.window(ts, step).alias("__window")).agg(*whole_columns(aggs))
    return grouped.select(*keys, F.col("__window.start").alias(ts), *aggs)
