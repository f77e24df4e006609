from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_to_parquet(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    until_caught_up: bool = True,
    partition_by: list[str] | None = None,
) -> StreamingQuery:
    """Start writing a stream to parquet files, each row exactly once.

    ``checkpoint`` must be in shared storage: a restarted query goes on from
    it. With ``until_caught_up`` the query ends when the present input is
    consumed.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if until_caught_up:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def rows_dropped(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, in the micro-batches Spark still reports on (the last hundred)."""
    return sum(
        state["numRowsDroppedByWatermark"] for batch in query.recentProgress for state in batch["stateOperators"]
    )
