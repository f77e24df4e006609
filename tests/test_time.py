from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostgrid.functions import floor_div, from_micros, micros, step_micros
from tests.frames import EPOCH, frame

TIMES = [
    datetime(2024, 3, 10, 2, 30, 0, 500000),  # skipped by a clock change in New York
    datetime(2024, 11, 3, 1, 30, 0, 1),  # there twice
    datetime(1969, 12, 31, 23, 59, 59, 999999),
    datetime(1960, 3, 10, 2, 30, 0, 123456),
    datetime(1800, 1, 1, 0, 0, 0, 1),
    datetime(1970, 1, 1),
    datetime(2024, 1, 1, 0, 0, 7, 179575),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_do_not_depend_on_the_session_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = frame(spark, "ts timestamp_ntz", [(t,) for t in TIMES])
        us = micros(df, "ts")
        got = df.select("ts", us.alias("us"), from_micros(us, T.TimestampNTZType()).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row in got:
        delta = row.ts - EPOCH
        assert row.us == (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
        assert row.back == row.ts


def test_micros_of_instants(spark):
    df = spark.range(1).select(F.timestamp_micros(F.lit(-1500001)).alias("ts"))
    us = micros(df, "ts")
    row = df.select(us.alias("us"), (from_micros(us, T.TimestampType()) == F.col("ts")).alias("same")).first()
    assert (row.us, row.same) == (-1500001, True)


def test_floor_div(spark):
    df = frame(spark, "x bigint", [(-7,), (-6,), (-1,), (0,), (5,), (6,), (1 << 60,)])
    for row in df.select("x", floor_div(F.col("x"), 6).alias("q")).collect():
        assert row.q == row.x // 6


def test_step_micros():
    assert step_micros("15 minutes") == 900_000_000
    assert step_micros("1 day") == 86_400_000_000
    for wrong in ("1 month", "0 hours", "-1 hour", "hour", ""):
        with pytest.raises(ValueError):
            step_micros(wrong)
