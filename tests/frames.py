"""Small hand-made frames and plain comparison of results."""

from datetime import datetime, timedelta

EPOCH = datetime(1970, 1, 1)


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(microseconds=round(seconds * 1_000_000))


def frame(spark, schema, rows):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _plain(value, digits):
    return round(value, digits) if isinstance(value, float) else value


def rows_of(df, digits=9):
    return sorted((tuple(_plain(v, digits) for v in r) for r in df.collect()), key=repr)


def ordered(rows, digits=9):
    return sorted((tuple(_plain(v, digits) for v in r) for r in rows), key=repr)
