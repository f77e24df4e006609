"""One query per operator, or per mode of one, over the stored tables.

Names in ``_small_limits`` run another query with limits so low that its groups
count as large.

Sums and averages of doubles depend on the order of addition, so they are
rounded before they are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostgrid.functions import count, high, low, mean, total
from frostgrid.operators import (
    as_of_join,
    gap_fill,
    geo_rollup,
    overlap_counts,
    overlap_join,
    quantile_profile,
    resample,
    rolling_zscore,
    sessionize,
    threshold_spells,
    top_k,
)
from frostgrid.session import shared_dir
from frostgrid.sources import read_table, stream_table
from frostgrid.streaming import append_to_parquet, stream_resample, with_open_buckets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def hourly_high(df: DataFrame, key: str) -> DataFrame:
    return resample(df, "ts", [key], "1 hour", {"max_value": high("value")})


@query
def resample_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per type and hour."""
    aggs = {"n": count(), "avg_value": mean("value"), "min_value": low("value"), "max_value": high("value")}
    return rounded(resample(events(spark, sf_dir), "ts", ["event_type"], "1 hour", aggs), avg_value=6)


@query
def resample_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar months: orders per priority."""
    aggs = {"n": count(), "sum_price": total("o_totalprice"), "max_price": high("o_totalprice")}
    orders = read_table(spark, sf_dir, "orders")
    return rounded(resample(orders, "o_orderdate", ["o_orderpriority"], "month", aggs), sum_price=2)


@query
def gap_fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full hourly grid per type, with nulls in empty hours."""
    return gap_fill(hourly_high(events(spark, sf_dir), "event_type"), "ts", ["event_type"], "1 hour")


@query
def gap_fill_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full hourly grid per user, with the last value carried forward."""
    return gap_fill(hourly_high(events(spark, sf_dir), "user_id"), "ts", ["user_id"], "1 hour", method="last")


@query
def gap_fill_last_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = hourly_high(events(spark, sf_dir), "user_id")
    return gap_fill(hourly, "ts", ["user_id"], "1 hour", method="last", chunk_steps=50)


@query
def threshold_spell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken hours with a peak of 100 or more, per type."""
    return threshold_spells(
        hourly_high(events(spark, sf_dir), "event_type"), "ts", ["event_type"],
        F.col("max_value") >= 100, "1 hour", aggs={"peak": high("max_value")},
    )


@query
def threshold_spell_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_spells(
        hourly_high(events(spark, sf_dir), "event_type"), "ts", ["event_type"],
        F.col("max_value") >= 100, "1 hour", aggs={"peak": high("max_value")}, chunk_steps=10,
    )


@query
def threshold_spell_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of three hours or more with the mean of their hourly peaks."""
    spells = threshold_spells(
        hourly_high(events(spark, sf_dir), "event_type"), "ts", ["event_type"],
        F.col("max_value") >= 50, "1 hour", min_len=3,
        aggs={"lowest": low("max_value"), "mean_peak": mean("max_value")},
    )
    return rounded(spells, mean_peak=6)


@query
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user merged over silences of up to six hours."""
    aggs = {"n": count(), "sum_value": total("value"), "peak": high("value")}
    return rounded(sessionize(events(spark, sf_dir), "ts", ["user_id"], "6 hours", aggs), sum_value=2)


@query
def sessions_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"n": count(), "sum_value": total("value"), "peak": high("value")}
    return rounded(
        sessionize(events(spark, sf_dir), "ts", ["user_id"], "6 hours", aggs, chunk_cells=4), sum_value=2
    )


def errors_and_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_events = events(spark, sf_dir)
    errors = all_events.where(F.col("event_type") == "error").select("event_id", "user_id", "ts", "value")
    views = all_events.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
    return errors, views


@query
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the latest view of its user."""
    errors, views = errors_and_views(spark, sf_dir)
    return as_of_join(errors, views, "ts", ["user_id"])


@query
def as_of_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, views = errors_and_views(spark, sf_dir)
    return as_of_join(errors, views, "ts", ["user_id"], hot_rows=20)


@query
def as_of_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the latest view of its user, if no older than 12 hours."""
    errors, views = errors_and_views(spark, sf_dir)
    return as_of_join(errors, views, "ts", ["user_id"], tolerance="12 hours")


def outages_and_crews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Intervals: six hours from each error, three hours from each signup."""

    def intervals(event_type: str, hours: int) -> DataFrame:
        rows = events(spark, sf_dir).where(F.col("event_type") == event_type)
        return rows.select(
            "event_id", "user_id", F.col("ts").alias("start"),
            (F.col("ts") + F.expr(f"interval '{hours}' hour")).alias("end"),
        )

    return intervals("error", 6), intervals("signup", 3)


@query
def overlap_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_join(outages, crews, ["user_id"])


@query
def overlap_by_user_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_join(outages, crews, ["user_id"], how="left")


@query
def overlap_any_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No key but time. All pairs are asked for; where a number will do, see the next query."""
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_join(outages, crews)


@query
def overlap_any_user_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_join(outages, crews, pairs_per_row=5, hot_rows=30)


@query
def overlap_counts_any_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many crews, of any user, were there during each outage."""
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_counts(outages, crews)


@query
def overlap_counts_any_user_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_counts(outages, crews, hot_rows=30)


@query
def overlap_by_user_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    outages, crews = outages_and_crews(spark, sf_dir)
    return overlap_join(outages, crews, ["user_id"], pairs_per_row=0, hot_rows=5)


@query
def rolling_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading against the seven days of its user before it."""
    readings = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return rounded(rolling_zscore(readings, "ts", ["user_id"], "value", "7 days"), zscore=6)


@query
def rolling_zscores_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    scores = rolling_zscore(readings, "ts", ["user_id"], "value", "7 days", hot_rows=30)
    return rounded(scores, zscore=6)


PROBS = [0.05, 0.5, 0.95]
ACCURACY = 10_000


@query
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = events(spark, sf_dir).select("event_type", "value")
    profile = quantile_profile(readings, ["event_type"], "value", PROBS)
    return rounded(profile, p5=6, p50=6, p95=6)


@query
def quantiles_small_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = events(spark, sf_dir).select("event_type", "value")
    profile = quantile_profile(readings, ["event_type"], "value", PROBS, hot_rows=1_000)
    return rounded(profile, p5=6, p50=6, p95=6)


@query
def quantiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quantiles, and whether the rank of each is within its bound.

    A sketch's answers are not determined by the data, its bound is.
    """
    readings = events(spark, sf_dir).select("event_type", "value")
    profile = quantile_profile(readings, ["event_type"], "value", PROBS, exact=False, accuracy=ACCURACY)
    n = F.count("value")

    def within(name: str, prob: float) -> Column:
        below, upto = (F.count(F.when(c, 1)) for c in (F.col("value") < F.col(name), F.col("value") <= F.col(name)))
        slack = n / ACCURACY + 1
        return (below <= n * prob + slack) & (upto >= n * prob - slack)

    ranks = readings.join(profile, "event_type").groupBy("event_type")
    return ranks.agg(
        n.alias("n"), *[within(name, p).alias(f"{name}_within") for name, p in zip(["p5", "p50", "p95"], PROBS)]
    )


@query
def rollup_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation, per region and overall.

    Orders are summed per customer before the join. The sum leaves the rows
    partitioned as the join needs them, so it costs no shuffle of its own,
    and a customer with very many orders joins as one row.
    """
    per_customer = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("price"), F.count(F.lit(1)).alias("orders")
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    placed = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    rolled = geo_rollup(placed, ["r_name", "n_name"], {"n_orders": total("orders"), "sum_price": total("price")})
    return rounded(rolled, sum_price=2)


@query
def top_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest readings per type."""
    readings = events(spark, sf_dir).select("event_type", "event_id", "ts", "value")
    return top_k(readings, ["event_type"], [F.desc("value"), F.asc("event_id")], 10)


@query
def stream_resample_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: days per type, closed ones as written to files, and those still open."""
    stream = stream_table(spark, sf_dir, "events")
    aggs = {"n": count(), "avg_value": mean("value"), "max_value": high("value")}
    days = stream_resample(stream, "ts", ["event_type"], "1 day", "1 hour", aggs)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    append_to_parquet(days, f"{folder}/days", f"{folder}/progress").awaitTermination()
    closed = spark.read.schema(days.schema).parquet(f"{folder}/days")
    every = with_open_buckets(closed, events(spark, sf_dir), "ts", ["event_type"], "1 day", aggs)
    return rounded(every, avg_value=6)
