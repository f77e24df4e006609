from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, whole_columns
from frostgrid.functions.time import from_micros, micros
from frostgrid.operators.hot import join_groups
from frostgrid.operators.resample import resample


def stream_resample(
    stream: DataFrame, ts: str, keys: list[str], step: str, lateness: str, aggs: dict[str, Agg]
) -> DataFrame:
    """:func:`frostgrid.operators.resample` on a stream, for append output.

    A bucket is emitted once, when an event later than its end by ``lateness``
    has been seen; rows that come after that are dropped (see
    :func:`frostgrid.streaming.rows_dropped`). Buckets still open when the
    input ends are not emitted; :func:`with_open_buckets` adds them.

    State is one small record per key and open bucket, kept by Spark on a hash
    of both, so a busy key spreads over its buckets and is reduced before the
    shuffle.
    """
    dtype = stream.schema[ts].dataType
    events = stream.withColumn("__event_time", F.timestamp_micros(micros(stream, ts)))
    buckets = (
        events.withWatermark("__event_time", lateness)
        .groupBy(*keys, F.window("__event_time", step).alias("__window"))
        .agg(*whole_columns(aggs))
    )
    start = from_micros(F.unix_micros(F.col("__window.start")), dtype)
    return buckets.select(*keys, start.alias(ts), *aggs)


def with_open_buckets(
    closed: DataFrame, events: DataFrame, ts: str, keys: list[str], step: str, aggs: dict[str, Agg]
) -> DataFrame:
    """What :func:`stream_resample` has emitted, ``closed``, and the buckets it still holds open.

    ``events`` is the stream's whole input as a table. Adds ``closed``: true as
    emitted, false for a bucket that more events may still change. A bucket is
    open if it was not emitted, so one whose events all came too late is open
    here as well.
    """
    pending = join_groups(resample(events, ts, keys, step, aggs), closed.select(*keys, ts), [*keys, ts], "left_anti")
    emitted = closed.withColumn("closed", F.lit(True))
    return emitted.unionByName(pending.withColumn("closed", F.lit(False)))
