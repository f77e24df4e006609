"""Lists of hosts and URLs that change over time, joined to captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, join_lookup
from frostgrid.llm.urls import canonical_url, host_of, host_suffixes


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated list entries as intervals: ``list``, ``allow``, ``key``, ``valid_from`` and ``valid_to`` (not in it; null: open).

    ``entries`` has ``list``, ``allow`` (whether the list permits what it names),
    ``key``, ``day`` and ``listed``: true adds the key from this day on, false removes it. Of
    several entries of a day a removal counts last. Entries without list, key,
    day or ``listed`` go; an ``allow`` of null is false.

    Entries of a day are put together before any key is sorted, so a key has at
    most a row per list and day.
    """
    known = entries.select(
        "list", F.coalesce("allow", F.lit(False)).alias("allow"), "key", F.col("day").cast("date").alias("day"), "listed"
    ).dropna()
    daily = known.groupBy("list", "allow", "key", "day").agg(F.min("listed").alias("listed"))
    by_key = Window.partitionBy("list", "allow", "key").orderBy("day")
    spans = daily.withColumn("valid_to", F.lead("day").over(by_key)).where("listed")
    return spans.select("list", "allow", "key", F.col("day").alias("valid_from"), "valid_to")


def _active(key_days: DataFrame, intervals: DataFrame) -> DataFrame:
    """``key_day`` and the lists active for it; ``key_days`` has no repeats."""
    inside = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    found = key_days.join(intervals.withColumnRenamed("key", "__key"), (F.col("key") == F.col("__key")) & inside)
    return found.groupBy(_key_day("key").alias("key_day")).agg(F.collect_set(F.struct("list", "allow")).alias("lists"))


def _key_day(key: str):
    return F.concat_ws(" ", F.col("day").cast("string"), F.col(key))


def filter_captures(
    captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", day_col: str = "day"
) -> DataFrame:
    """Evaluate every capture against the lists as they stood when it was fetched.

    An entry's key is a host, which covers the hosts below it, or a whole URL
    with its scheme, in canonical form. One row per capture: ``id_col``, ``host``,
    ``lists`` (names of the active lists that name it, sorted) and ``blocked``: named
    by a list, and by none that allows. A capture without URL or day is named
    by none. Repeated captures stay, repeated entries count once.

    The as-of join runs on days and distinct keys, not on captures: a key has
    at most a row per day, however many captures it covers. What it finds is
    looked up, under salts where it is too large for a broadcast.
    """
    intervals = checkpointed(
        validity_intervals(
            entries.withColumn("key", F.when(F.contains("key", F.lit("://")), canonical_url("key")).otherwise(F.lower("key")))
        )
    )
    rows = captures.select(
        F.col(id_col).alias("__id"), F.col(day_col).cast("date").alias("day"),
        host_of(url_col).alias("host"), canonical_url(url_col).alias("url"),
    )
    hosts = rows.where("host is not null and day is not null").select("host", "day").distinct()
    suffixes = hosts.withColumn("key", F.explode(host_suffixes("host")))
    # Only URLs that some list names at some time.
    named = intervals.where(F.contains("key", F.lit("://"))).select(F.col("key").alias("named")).distinct()
    urls = rows.join(named, F.col("url") == F.col("named"), "left_semi").select(F.col("url").alias("key"), "day")
    key_days = suffixes.select("key", "day").unionByName(urls).where("day is not null").distinct()
    active = checkpointed(_active(key_days, intervals))

    by_key = join_lookup(suffixes.withColumn("key_day", _key_day("key")), active, "key_day", F.col("host"), "inner")
    of_host = by_key.groupBy(_key_day("host").alias("host_day")).agg(
        F.array_distinct(F.flatten(F.collect_list("lists"))).alias("host_lists")
    )
    keyed = rows.withColumns({"host_day": _key_day("host"), "key_day": _key_day("url")})
    with_host = join_lookup(keyed, checkpointed(of_host), "host_day", F.col("__id"))
    with_url = join_lookup(with_host, active, "key_day", F.col("__id"))
    none = F.array().cast("array<struct<list: string, allow: boolean>>")
    found = F.when(F.col("day").isNull(), none).otherwise(
        F.array_union(F.coalesce("host_lists", none), F.coalesce("lists", none))
    )
    judged = with_url.select(F.col("__id").alias(id_col), "host", found.alias("found"))
    return judged.select(
        id_col, "host", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["list"]))).alias("lists"),
        ((F.size("found") > 0) & ~F.exists("found", lambda x: x["allow"])).alias("blocked"),
    )
