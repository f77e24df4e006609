"""Operators on streams, and writing their results."""

from frostgrid.streaming.resample import stream_resample, with_open_buckets
from frostgrid.streaming.sinks import append_to_parquet, rows_dropped

__all__ = ["append_to_parquet", "rows_dropped", "stream_resample", "with_open_buckets"]
