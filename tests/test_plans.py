"""What the physical plans must and must not contain."""

import re

import pytest

from frostgrid.plans import queries as registered
from frostgrid.plans.oracle import SMALL_LIMITS

SF_DIR = "/root/testdata/sf0.001"
BATCH = sorted(n for n in registered.QUERIES if n != "stream_resample_daily" and not n.endswith(SMALL_LIMITS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Plans as they would be with tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {name: plan_of(registered.QUERIES[name](spark, SF_DIR)) for name in BATCH}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_python_or_single_partitions(plans, name):
    plan = plans[name]
    for word in ("CartesianProduct", "BroadcastNestedLoop", "Python", "SinglePartition", "BroadcastExchange"):
        assert word not in plan, word


@pytest.mark.parametrize("name", BATCH)
def test_scans_read_only_needed_columns(plans, name):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]):
        assert "props" not in schema and "c_name" not in schema and "o_orderpriority" not in schema.replace(
            "o_orderpriority" if name == "resample_monthly" else "-", ""
        )


def test_filters_reach_the_scan(plans):
    for name in ("as_of", "overlap_by_user", "overlap_counts_any_user"):
        assert plans[name].count("EqualTo(event_type,") >= 2


def test_top_k_limits_groups_before_the_shuffle(plans):
    plan = plans["top_readings"]
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_number_of_shuffles(plans):
    """Shuffles of input rows or larger; AQE reuses the equal ones of gap filling at run time."""
    assert plans["resample_hourly"].count("Exchange hashpartitioning") == 1
    assert plans["as_of"].count("Exchange hashpartitioning") == 1
    assert plans["rolling_zscores"].count("Exchange hashpartitioning") == 1
    assert plans["threshold_spell"].count("Exchange hashpartitioning") == 3
    assert plans["sessions"].count("Exchange hashpartitioning") == 3


def test_gap_fill_shuffles_its_rows_once(spark):
    df = registered.gap_fill_last(spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_customer_totals_join_without_another_shuffle(plans):
    plan = plans["rollup_by_place"]
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey", plan)) == 1


@pytest.mark.parametrize("name", ["gap_fill_last", "as_of", "rolling_zscores"])
def test_coalescing_does_not_tear_apart_chunks_and_their_first_rows(spark, name):
    """Rows and carried totals are united without a shuffle, so they must be coalesced alike or not at all."""
    settings = {
        "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plain, limited = (
            sorted(map(repr, registered.QUERIES[n](spark, "/root/testdata/sf0.01").collect()))
            for n in (name, name + SMALL_LIMITS)
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plain == limited
