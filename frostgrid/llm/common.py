"""What several operators of this package share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostgrid.session import ensure_checkpoint_dir, shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later uses do not compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them that keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) for c in taken), default=0)
    return [n if n.lower() not in taken else "_" * (longest + 1) + n for n in names]


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Rows of a few numbers that one task takes at least.
TASK_ROWS = 100_000


def enough_tasks(rows: int | None) -> int:
    """Tasks for a step on so many short rows, to ``coalesce`` to.

    A step of a shuffle writes files for each task, and tasks in proportion to
    the session's partitions would outweigh few rows. None counts as no rows.
    """
    return max(-(-(rows or 0) // TASK_ROWS), 1)


def give_back() -> None:
    """Return freed memory to the system.

    Python workers wait for the next task for a minute and would hold on to it, beside
    the executor that needs it for the next stage.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 4_000_000
SALTS = 32


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, salt: Column, how: str = "left") -> DataFrame:
    """Join ``lookup``, a table with one row per ``key``, where null equals null.

    ``lookup`` is counted and measured first: up to ``BROADCAST_ROWS`` rows of
    ``BROADCAST_BYTES`` in all it is broadcast. A larger one is repeated under
    ``SALTS`` salts and ``df`` is dealt out by key and ``salt``, so that no task
    gets all the rows of one key.
    """
    size = lookup.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).collect()[0]
    other = lookup.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(other), same, how).drop("__key")
    other = other.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return salted.join(other, same & (F.col("__salt") == F.col("__of")), how).drop("__key", "__of", "__salt")


HOT_ROWS = 1_000


def join_classes(df: DataFrame, lookup: DataFrame, key: str, salt: Column, how: str = "left") -> DataFrame:
    """Join ``lookup``, a table with one row per ``key``, whose column ``n`` is the number of rows of ``df`` with it.

    Keys are not null; ``df`` and ``lookup`` have no other column in common. Keys of more than ``HOT_ROWS`` rows, which are
    few for the rows they stand for, are joined by :func:`join_lookup`, so that
    no task gets all the rows of one. The others are joined by a shuffle on the key.
    """
    hot = lookup.where(F.col("n") > HOT_ROWS).withColumn("__hot", F.lit(True))
    marked = join_lookup(df, hot, key, salt)
    found = marked.where("__hot").drop("__hot")
    cold = lookup.where(F.col("n") <= HOT_ROWS)
    rest = marked.where("__hot is null").select(*df.columns).join(cold, key, how)
    return found.select(*df.columns, *[c for c in lookup.columns if c != key]).unionByName(rest)
