from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.operators.hot import HOT_ROWS, checkpointed, hot_groups, join_groups, only_hot, without_hot

# Rank error of the sketch that brackets a quantile is 1/SKETCH_ACCURACY of the rows.
SKETCH_ACCURACY = 100_000


def quantile_name(prob: float) -> str:
    return "p" + f"{prob * 100:g}".replace(".", "_")


def quantile_profile(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    exact: bool = True,
    accuracy: int = 10_000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Quantiles of ``value`` per group, one column ``p<percent>`` each.

    Values count as doubles, NaN as the largest. Exact quantiles interpolate
    linearly between neighbours; where both are the same, as two infinities
    are, that is the answer. Without keys there is one row, also of an empty
    table. With
    ``exact=False`` each is a value whose rank is off by at most
    ``1/accuracy`` of the group, from a mergeable sketch of fixed size.

    Spark's exact ``percentile`` keeps the distinct values of a group in one
    task's memory. Groups of more than ``hot_rows`` values are therefore solved
    by selection: a sketch brackets each quantile, one pass counts the values
    below the bracket, and only the values inside are sorted, each bracket by
    itself. Both ways give the same answer to the last digit.
    """
    # Adding 0 makes one of the two zeros.
    df = df.withColumn(value, F.col(value).cast("double") + F.lit(0.0))
    names = [quantile_name(p) for p in probs]
    if not exact:
        sketch = F.percentile_approx(value, probs, accuracy).alias("__q")
        return _spread(df.groupBy(*keys).agg(sketch), keys, names)
    if not keys:
        one_group = df.select(F.lit(1).alias("__all"), value)
        found = quantile_profile(one_group, ["__all"], value, probs, hot_rows=hot_rows)
        # An aggregate without keys has a row even where nothing was found.
        return found.groupBy().agg(*[F.max(name).alias(name) for name in names])
    hot = hot_groups(df.where(F.col(value).isNotNull()), keys, hot_rows)
    if hot is None:
        return _spread(_by_percentile(df, keys, value, probs), keys, names)
    return _spread(_by_percentile(without_hot(df, hot, keys), keys, value, probs), keys, names).unionByName(
        _by_selection(only_hot(df, hot, keys), keys, value, probs, names, hot_rows)
    )


def _spread(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col("__q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def _by_percentile(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("__q"))


def _by_selection(
    df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str], least_rows: int
) -> DataFrame:
    # The error of the sketch, and three rows for ranks that are rounded.
    margin = 4 / SKETCH_ACCURACY + 3 / least_rows
    # In the sketch NaN counts as infinite, which keeps the order.
    number = F.nanvl(F.col(value), F.lit(float("inf")))
    edges = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    groups = checkpointed(
        df.groupBy(*keys).agg(
            F.count(value).alias("__n"),
            F.percentile_approx(number, edges, SKETCH_ACCURACY).alias("__edges"),
        )
    )
    rows = join_groups(df.where(F.col(value).isNotNull()).select(*keys, value), groups, keys, "inner")

    # Each bracket keeps the number of values below it and counts its own one by one.
    v, brackets = F.col(value), range(len(probs))
    low = [F.col("__edges")[2 * i] for i in brackets]
    high = [
        F.when(F.col("__edges")[2 * i + 1] == float("inf"), F.lit(float("nan"))).otherwise(F.col("__edges")[2 * i + 1])
        for i in brackets
    ]
    below = rows.groupBy(*keys).agg(*[F.count(F.when(v < low[i], 1)).alias(f"__below{i}") for i in brackets])
    inside = F.array_compact(F.array(*[F.when(v.between(low[i], high[i]), F.lit(i)) for i in brackets]))
    counts = rows.select(*keys, "__n", value, F.explode(inside).alias("__bracket")).groupBy(
        *keys, "__n", "__bracket", v.alias("__v")
    ).count()
    by_value = Window.partitionBy(*keys, "__bracket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("count").over(by_value))

    p_of = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("__bracket") + 1)
    below_of = F.element_at(F.array(*[F.col(f"__below{i}") for i in brackets]), F.col("__bracket") + 1)
    placed = join_groups(ranked, checkpointed(below), keys, "inner").withColumns(
        {"__upto": F.col("__upto") + below_of, "__rank": p_of * (F.col("__n") - 1)}
    )

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("__upto") > rank, F.struct("__upto", "__v")))["__v"]

    one = placed.groupBy(*keys, "__bracket", "__rank").agg(
        at_rank(F.floor("__rank")).alias("__low"), at_rank(F.ceil("__rank")).alias("__high")
    )
    # The weights that Spark's percentile uses.
    up, down = F.ceil("__rank") - F.col("__rank"), F.col("__rank") - F.floor("__rank")
    value_at = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(
        up * F.col("__low") + down * F.col("__high")
    )
    found = one.withColumn("__value", value_at)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__bracket") == i, F.col("__value"))).alias(name) for i, name in enumerate(names)]
    )
