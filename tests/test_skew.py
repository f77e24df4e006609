"""With nine of ten rows under one key, no task may be handed most of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frostgrid.functions import count, high, total
from frostgrid.operators import (
    as_of_join,
    gap_fill,
    geo_rollup,
    overlap_join,
    quantile_profile,
    resample,
    rolling_zscore,
    sessionize,
    threshold_spells,
    top_k,
)
from frostgrid.operators import ranges as ranges_module
from frostgrid.operators.ranges import points_in_ranges

ROWS = 200_000
HOT = 10_000


@pytest.fixture(scope="module")
def readings(spark):
    """One row a second; the hot key's come in bursts of ten in a second."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    i = F.col("id")
    user = F.when(i % 10 == 0, i % 97).otherwise(-1)
    us = F.when(user == -1, i - i % 10).otherwise(i) * 1_000_000 + i % 10
    yield spark.range(ROWS).select(
        i, user.alias("user"), F.timestamp_micros(us).alias("ts"),
        (F.pmod(F.xxhash64(i), F.lit(1_000_000)) / 100).alias("value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def stages(sc):
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store = sc._jsc.sc().statusStore()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    found = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return store, [found.apply(i) for i in range(found.size())]


def most_records_read(spark, build):
    """Of all tasks that ``build`` causes to run, the most shuffled records one of them read."""
    sc = spark.sparkContext
    done = {s.stageId() for s in stages(sc)[1]}
    rows = build().collect()
    store, now = stages(sc)
    most = 0
    for stage in now:
        if stage.stageId() not in done and stage.shuffleReadRecords() > 0:
            tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return len(rows), most


def views(readings):
    return readings.where("id % 3 = 1").select("user", "ts", F.col("value").alias("seen"))


def intervals(readings):
    return readings.select(
        "id", "user", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 seconds")).alias("end")
    )


CASES = {
    "resample": lambda r: resample(r, "ts", ["user"], "1 hour", {"n": count(), "peak": high("value")}),
    "gap_fill": lambda r: gap_fill(
        resample(r, "ts", ["user"], "20 seconds", {"n": count()}), "ts", ["user"], "20 seconds", "last", 256
    ),
    "spells": lambda r: threshold_spells(
        resample(r, "ts", ["user"], "20 seconds", {"peak": high("value")}), "ts", ["user"],
        F.col("peak") > 5000, "20 seconds", chunk_steps=256,
    ),
    "sessions": lambda r: sessionize(r, "ts", ["user"], "30 seconds", {"n": count()}, 256),
    "as_of": lambda r: as_of_join(r, views(r), "ts", ["user"], tie_break="seen", hot_rows=HOT),
    "rolling": lambda r: rolling_zscore(r, "ts", ["user"], "value", "1 day", hot_rows=HOT),
    "quantiles": lambda r: quantile_profile(r, ["user"], "value", [0.1, 0.5], hot_rows=HOT),
    "rollup": lambda r: geo_rollup(r, ["user"], {"n": count(), "s": total("value")}),
    "top_k_large": lambda r: top_k(r.select("id", "user", "value"), ["user"], [F.desc("value"), F.asc("id")], 200),
    "overlap": lambda r: overlap_join(
        intervals(r).where("id % 50 = 3"), intervals(r), ["user"], pairs_per_row=1, hot_rows=HOT
    ).select("id", "id_right"),
    "top_k": lambda r: top_k(r.select("id", "user", "value"), ["user"], [F.desc("value"), F.asc("id")], 5),
}


@pytest.mark.parametrize("name", CASES)
def test_no_task_reads_most_of_the_rows(spark, readings, name):
    found, most = most_records_read(spark, lambda: CASES[name](readings))
    print(name, found, most)
    assert found > 0 and most > 0
    # Rolling scores shuffle each row twice, once for either of its two pieces.
    assert most < ROWS / 3 * (2 if name == "rolling" else 1)


def test_a_plain_window_would(spark, readings):
    """The measure sees skew where there is some."""
    w = Window.partitionBy("user").orderBy("ts")
    found, most = most_records_read(spark, lambda: readings.withColumn("before", F.lag("value").over(w)))
    assert found == ROWS and most > ROWS * 0.8


def test_overlap_join_does_not_compare_all_rows_of_a_key(spark, readings):
    """Nine tenths of the rows share a key, yet each meets only its own seconds."""
    others = intervals(readings).where("id % 7 = 0")
    pairs = overlap_join(intervals(readings), others, ["user"])
    expected = others.count()
    assert pairs.where("id = id_right").count() == expected
    assert pairs.count() < ROWS * 3


def test_ranges_of_many_points_are_few_rows(spark):
    """A thousand ranges of 20,000 points each: what is shuffled grows with the rows, not with the pairs."""
    width = F.lit(30_000).alias("__width")
    points = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("__point"), width)
    ranges = spark.range(1_000).select(
        F.lit(1).alias("key"), (-F.col("id")).alias("__from"), (F.col("id") + 20_000).alias("__to"), width
    )
    done = {s.stageId() for s in stages(spark.sparkContext)[1]}
    assert points_in_ranges(points, ranges, ["key"], 1_000_000).count() == 20_000_000
    now = [s for s in stages(spark.sparkContext)[1] if s.stageId() not in done]
    assert sum(s.shuffleWriteRecords() for s in now) < 300_000


def test_points_of_one_position_go_to_many_tasks(spark, monkeypatch):
    """All points stand at one position and all ranges hold it: a task has a block's pairs, not the position's."""
    monkeypatch.setattr(ranges_module, "PAIRS_PER_TASK", 50_000)
    width = F.lit(10).alias("__width")
    points = spark.range(5_000).select(F.lit(1).alias("key"), "id", F.lit(5).cast("bigint").alias("__point"), width)
    ranges = spark.range(200).select(
        F.lit(1).alias("key"), F.col("id").alias("range"), (-F.col("id")).alias("__from"), F.lit(6).cast("bigint").alias("__to"), width
    )
    pairs = points_in_ranges(points, ranges, ["key"], 1_000_000)
    tasks = pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), F.countDistinct("range", "id")).collect()
    assert sum(t[1] for t in tasks) == sum(t[2] for t in tasks) == 1_000_000
    assert max(t[1] for t in tasks) < 700_000
