from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(directory, name))


def stream_table(
    spark: SparkSession, directory: str, name: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The table as a stream of files, with the schema its files have now.

    The stream source takes a folder or a pattern but not the path of one file,
    so the path is given as a pattern that matches only itself.
    """
    path = table_path(directory, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path[:-1] + f"[{path[-1]}]")
