"""Revisit records of web archives, resolved to the response they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.urls import canonical_url

CELL_SECONDS = 3600
# The header fields that a not-modified answer may carry anew.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def _lower_names(headers: str) -> Column:
    """Header fields with names in lower case; of fields that then share a name the last counts."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def put(known: Column, field: Column) -> Column:
        name = F.lower(field["key"])
        return F.map_concat(F.map_filter(known, lambda k, _: k != name), F.create_map(name, field["value"]))

    return F.aggregate(F.map_entries(F.coalesce(F.col(headers), empty)), empty, put)


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^[Ww]/", "")


def resolve_revisits(records: DataFrame, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Each revisit with the latest full response of its URL before it.

    ``records`` has ``record_id``, ``url``, ``fetched`` (timestamp), ``kind`` (``response`` or
    ``revisit``), ``status`` (int), ``headers`` (map of strings) and ``payload_digest``. A full
    response is one of status 200; URLs are compared in canonical form, ``fetched``
    strictly, and of responses fetched at once the largest ``record_id`` counts.

    One row per revisit: ``record_id``, ``url`` (canonical), ``outcome``, ``refers_to``,
    ``payload_digest`` and ``headers``. The outcome is ``resolved``; ``mismatch`` if the entity
    tags of both differ or, where one has none, their last-modified fields; or
    ``no response``, also for a revisit without URL or time. Where it is resolved the
    headers are the response's, with those in ``PERMITTED`` that the revisit has
    anew; else they are the revisit's own and there is no payload.

    A URL is not sorted in one task: it is cut into cells of ``cell_seconds``. Each
    cell keeps its last response, and these are carried on from cell to cell.
    Moments, not records, are sorted, so records of one moment meet only in a join.
    """
    known = records.select(
        "record_id", canonical_url("url").alias("url"), "fetched", "kind", "status",
        _lower_names("headers").alias("headers"), "payload_digest",
    )
    revisits = known.where("kind = 'revisit'")
    timed = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    cell = F.floor(F.unix_micros(F.col("fetched").cast("timestamp")) / F.lit(cell_seconds * 1_000_000))
    answer = F.struct("record_id", "payload_digest", F.map_entries("headers").alias("fields"))
    full = known.where(timed & (F.col("kind") == "response") & (F.col("status") == 200))
    responses = full.groupBy("url", "fetched").agg(F.max(answer).alias("answer"))
    asked = revisits.where(timed).groupBy("url", "fetched").agg(F.lit(None).cast(responses.schema["answer"].dataType).alias("answer"))
    moments = responses.unionByName(asked).groupBy("url", "fetched").agg(F.max("answer").alias("answer"))
    moments = moments.withColumn("cell", cell)

    in_cell = Window.partitionBy("url", "cell").orderBy("fetched").rowsBetween(Window.unboundedPreceding, -1)
    inside = moments.withColumn("inside", F.last("answer", ignorenulls=True).over(in_cell))
    last = moments.groupBy("url", "cell").agg(
        F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("fetched"))).alias("last")
    )
    before = Window.partitionBy("url").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url", "cell", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = inside.join(carried, ["url", "cell"]).select(
        F.col("url").alias("__url"), F.col("fetched").alias("__fetched"), F.coalesce("inside", "carried").alias("answer")
    )

    same = (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__fetched"))
    joined = revisits.join(found, same, "left").withColumn("of", F.map_from_entries("answer.fields"))
    etags = F.col("headers")["etag"].isNotNull() & F.col("of")["etag"].isNotNull()
    dates = F.col("headers")["last-modified"].isNotNull() & F.col("of")["last-modified"].isNotNull()
    differ = F.when(etags, _strong(F.col("headers")["etag"]) != _strong(F.col("of")["etag"])).otherwise(
        dates & (F.col("headers")["last-modified"] != F.col("of")["last-modified"])
    )
    outcome = F.when(F.col("answer").isNull(), "no response").when(differ, "mismatch").otherwise("resolved")
    renewed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("of", lambda k, _: ~F.map_contains_key(renewed, k)), renewed)
    resolved = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "outcome", F.when(F.col("outcome") != "no response", F.col("answer.record_id")).alias("refers_to"),
        F.when(resolved, F.col("answer.payload_digest")).alias("payload_digest"),
        F.when(resolved, merged).otherwise(F.col("headers")).alias("headers"),
    )
