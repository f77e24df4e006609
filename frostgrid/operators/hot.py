"""Groups too large for one task, and the split of a table around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostgrid.session import ensure_checkpoint_dir

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def checkpointed(groups: DataFrame) -> DataFrame | None:
    """``groups``, kept so that every later use sees the same rows, or None when there are none.

    Runs a job for the rows and measures what it kept. Spark cannot tell the
    size of a checkpoint and would shuffle whatever is joined to it; up to
    ``BROADCAST_ROWS`` rows of ``BROADCAST_BYTES`` in all are marked for broadcast.
    """
    ensure_checkpoint_dir(groups.sparkSession)
    kept = groups.checkpoint()
    written = F.octet_length(F.to_json(F.struct("*")))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(written), F.lit(0))).collect()[0]
    if rows == 0:
        return None
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else kept


def kept_rows(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, for rows that several branches of a plan read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hot_groups(df: DataFrame, by: list[str], limit: int, *extra: Column) -> DataFrame | None:
    """Groups of more than ``limit`` rows, or None when there are none.

    Runs one job: a count per group, combined on the map side, reading only
    the columns it needs. The result has at most rows/limit rows. ``extra``
    columns are further aggregates to keep per hot group.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), *extra)
    return checkpointed(sizes.where(F.col("__rows") > limit).drop("__rows"))


def join_groups(df: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on the columns ``by``, where null equals null."""
    renamed = {name: f"__group_{name}" for name in by}
    condition = F.lit(True)
    for name, other in renamed.items():
        condition = condition & F.col(name).eqNullSafe(F.col(other))
    return df.join(groups.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())


def only_hot(df: DataFrame, hot: DataFrame, by: list[str]) -> DataFrame:
    return join_groups(df, hot.select(*by), by, "left_semi")


def without_hot(df: DataFrame, hot: DataFrame, by: list[str]) -> DataFrame:
    return join_groups(df, hot.select(*by), by, "left_anti")
