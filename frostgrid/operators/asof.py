from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.functions.time import duration_micros, micros
from frostgrid.operators.hot import HOT_ROWS, hot_groups, join_groups, without_hot
from frostgrid.operators.running import cell_width, running


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    ts: str,
    keys: list[str],
    tolerance: str | None = None,
    right_ts: str | None = None,
    tie_break: str | None = None,
    suffix: str = "_right",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it.

    Every left row is kept once. The right time and any right column whose
    name the left side has too get ``suffix``. A match older than ``tolerance``
    counts as none; with ``"0 seconds"`` only one of the same instant counts. Of several right rows at one instant the one with the
    greatest ``tie_break`` is taken; without it their instants must differ.

    Both sides are stacked and read in time order, so no pair is ever formed:
    one shuffle on the keys. Keys of more than ``hot_rows`` rows go another
    way: the instants asked for are made distinct and looked up piecewise (see
    :func:`running`), then joined back by key and instant, where adaptive
    execution can split the left side as finely as needed.
    """
    right_ts = right_ts or ts
    if not keys:
        one = F.lit(1)
        joined = as_of_join(
            left.withColumn("__all", one), right.withColumn("__all", one), ts, ["__all"],
            tolerance, right_ts, tie_break, suffix, hot_rows,
        )
        return joined.drop("__all")
    payload = [c for c in right.columns if c not in keys]
    names = {c: c + suffix if c in left.columns or c == right_ts else c for c in payload}

    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    seen = right.where(known & F.col(right_ts).isNotNull()).select(
        *keys,
        micros(right, right_ts).alias("__us"),
        F.struct(
            micros(right, right_ts).alias("__us"), *[F.col(c).alias(names[c]) for c in payload]
        ).alias("__match"),
        (F.struct(tie_break) if tie_break else F.struct(F.lit(0))).alias("__tie"),
    )
    asked = left.where(known & F.col(ts).isNotNull()).withColumn("__us", micros(left, ts))
    unmatchable = left.where(~known | F.col(ts).isNull()).withColumn(
        "__match", F.lit(None).cast(seen.schema["__match"].dataType)
    )

    instants = asked.select(*keys, "__us").unionByName(seen.select(*keys, "__us"))
    hot = hot_groups(instants, keys, hot_rows, cell_width("__us", hot_rows).alias("__width"))
    if hot is None:
        matched = _stacked(asked, seen, keys)
    else:
        matched = _stacked(
            without_hot(asked, hot, keys), without_hot(seen, hot, keys), keys
        ).unionByName(
            _looked_up(
                join_groups(asked, hot, keys, "inner"), join_groups(seen, hot, keys, "inner"), keys, hot_rows
            )
        )

    match: Column = F.col("__match")
    if tolerance is not None:
        match = F.when(F.col("__us") - match["__us"] <= duration_micros(tolerance), match)
    matched = matched.withColumn("__match", match).drop("__us")
    return matched.unionByName(unmatchable).select(
        *left.columns, *[F.col("__match")[names[c]].alias(names[c]) for c in payload]
    )


def _stacked(asked: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    rows = asked.withColumn("__asks", F.lit(1)).unionByName(
        seen.withColumn("__asks", F.lit(0)), allowMissingColumns=True
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy("__us", "__asks", "__tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("__match", F.last("__match", ignorenulls=True).over(w))
        .where(F.col("__asks") == 1)
        .drop("__asks", "__tie")
    )


def _looked_up(asked: DataFrame, seen: DataFrame, keys: list[str], limit: int) -> DataFrame:
    rows = asked.select(*keys, "__us", "__width", F.lit(1).alias("__asks")).unionByName(
        seen.withColumn("__asks", F.lit(0)), allowMissingColumns=True
    )
    instants = rows.groupBy(*keys, "__us", "__width").agg(
        F.max("__asks").alias("__asks"), F.max_by("__match", "__tie").alias("__match")
    )
    answers = running(instants, keys, "__us", {"__match": "last"}, "__width", rows, limit)
    answers = answers.where(F.col("__asks") == 1).drop("__asks")
    return asked.drop("__width").join(answers, [*keys, "__us"], "left")
