from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from frostgrid.functions.time import floor_div, micros, step_micros
from frostgrid.operators.hot import HOT_ROWS, hot_groups, join_groups, without_hot
from frostgrid.operators.running import cell_width, running


def rolling_zscore(
    df: DataFrame,
    ts: str,
    keys: list[str],
    value: str,
    lookback: str,
    name: str = "zscore",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``df`` with the z-score of ``value`` against the trailing ``lookback``.

    The frame holds every row of the key from ``lookback`` before the row up
    to its own instant, itself included. The score is null when the sample
    deviation is 0 or there is only one value, and for rows without a time.

    Spark computes a sliding frame anew for every row, which is quadratic in
    the rows per frame. Here time is cut into pieces one ``lookback`` long: a
    frame is then the tail of one piece and the head of the next. Each row
    takes part twice, as head of its own piece and as tail for the next one,
    and both are running aggregates of constant cost per row, with one shuffle
    on key and piece. Pieces of more than ``hot_rows`` rows are reduced to one
    row per instant and run over in cells (see :func:`running`).
    """
    span = step_micros(lookback)
    group = [*keys, "__piece"]
    timed = df.where(F.col(ts).isNotNull()).withColumn("__us", micros(df, ts))
    timed = timed.withColumn("__own", floor_div(F.col("__us"), span))
    own, us = F.col("__own"), F.col("__us")
    copies = F.array(
        F.struct(own.alias("__piece"), us.alias("__at"), F.lit(False).alias("__tail")),
        F.struct((own + 1).alias("__piece"), (us + span).alias("__at"), F.lit(True).alias("__tail")),
    )
    others = [c for c in df.columns if c not in (*keys, value)]
    rows = timed.withColumn("__copy", F.explode(copies)).select(
        *keys, "__copy.*", F.col(value),
        *[F.when(~F.col("__copy.__tail"), F.col(c)).alias(c) for c in others],
    )

    is_head, known = ~F.col("__tail"), F.col(value).isNotNull()
    hot = hot_groups(
        rows, group, hot_rows,
        F.min_by(value, F.when(is_head & known, F.col("__at"))).alias("__first"),
        F.max_by(value, F.when(~is_head & known, F.col("__at"))).alias("__last"),
        cell_width("__at", hot_rows).alias("__width"),
    )
    columns = [c for c in df.columns if c != name] + [name]
    cold = rows if hot is None else without_hot(rows, hot, group)
    scored = _by_windows(cold, group, value, name).select(*columns)
    if hot is not None:
        pieces = join_groups(rows, hot, group, "inner")
        scored = scored.unionByName(_by_cells(pieces, group, value, name, hot_rows).select(*columns))
    untimed = df.where(F.col(ts).isNull()).withColumn(name, F.lit(None).cast("double"))
    return scored.unionByName(untimed.select(*columns))


def _zscore(value: Column, head: Column, tail: Column) -> Column:
    """The score against two sets, each given as n, mean, squares, low and high.

    ``squares`` is the sum of squared differences from the mean; two of them
    are merged without subtracting large numbers. That the deviation is 0 is
    told from the extremes; a computed sum may miss 0 by a rounding error.
    """
    n = head["n"] + tail["n"]
    apart = head["mean"] - tail["mean"]
    mean = F.try_divide(head["n"] * head["mean"] + tail["n"] * tail["mean"], n)
    between = F.try_divide(apart * apart * head["n"] * tail["n"], n)
    deviation = F.sqrt((head["squares"] + tail["squares"] + between) / (n - 1))
    varied = F.least(head["low"], tail["low"]) < F.greatest(head["high"], tail["high"])
    return F.when((n > 1) & varied, F.try_divide(value - mean, deviation))


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _by_windows(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    at = F.col("__at")
    in_time = Window.partitionBy(*group).orderBy(at)
    back = Window.partitionBy(*group).orderBy(at.desc())

    def stats(v: Column, window: WindowSpec) -> Column:
        w = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        n = F.count(v).over(w)
        return F.struct(
            n.alias("n"),
            _or_zero(F.avg(v).over(w)).alias("mean"),
            _or_zero(F.var_pop(v).over(w) * n).alias("squares"),
            F.min(v).over(w).alias("low"),
            F.max(v).over(w).alias("high"),
        )

    v, tail = F.col("__v"), F.col("__tail")
    return (
        rows.withColumn("__v", F.col(value).cast("double"))
        .withColumn("__tail_stats", stats(F.when(tail, v), back))
        .withColumn("__head_stats", stats(F.when(~tail, v), in_time))
        .where(~tail)
        .withColumn(name, _zscore(v, F.col("__head_stats"), F.col("__tail_stats")))
    )


def _by_cells(rows: DataFrame, group: list[str], value: str, name: str, limit: int) -> DataFrame:
    """As :func:`_by_windows`, from running sums over one row per instant.

    Sums are taken of differences from a value that is in every head (the
    first one) or every tail (the last one). Differences from a value outside
    the frame, such as the mean of the piece, could drown those inside it.
    """
    tail, at = F.col("__tail"), F.col("__at")
    rows = rows.withColumn("__v", F.col(value).cast("double")).withColumn(
        "__d", F.col("__v") - F.when(tail, F.col("__last")).otherwise(F.col("__first"))
    )
    sums = {"__n": "sum", "__s": "sum", "__q": "sum", "__low": "min", "__high": "max"}

    def of_side(on_side: Column) -> Column:
        v, d = F.when(on_side, F.col("__v")), F.when(on_side, F.col("__d"))
        return F.struct(
            F.count(v).alias("__n"), F.sum(d).alias("__s"), F.sum(d * d).alias("__q"),
            F.min(v).alias("__low"), F.max(v).alias("__high"),
        )

    # Tails are run over from the end, hence the sign, and looked up at the instants
    # of heads, so those are on both sides.
    extent = [*group, "__width", "__first", "__last"]
    instants = rows.groupBy(*extent, at).agg(
        F.bool_or(~tail).alias("__asks"), of_side(~tail).alias("__head_sums"), of_side(tail).alias("__tail_sums")
    )
    sides = F.array(
        F.when(F.col("__asks"), F.struct(F.lit(1).alias("__sign"), F.col("__head_sums.*"))),
        F.struct(F.lit(-1).alias("__sign"), F.col("__tail_sums.*")),
    )
    position = (at * F.col("__side.__sign")).alias("__pos")
    points = (
        instants.withColumn("__side", F.explode(sides))
        .where(F.col("__side").isNotNull())
        .select("__asks", "__side.*", *extent, position)
    )
    sign = F.when(tail, -1).otherwise(1).alias("__sign")
    raw = rows.withColumn("__side", F.struct(sign)).select("__side.*", *extent, position)

    def stats(side: int, base: str) -> Column:
        n, s, q, low, high = (F.max(F.when(F.col("__sign") == side, F.col(c))) for c in sums)
        return F.struct(
            n.alias("n"),
            _or_zero(F.col(base) + F.try_divide(s, n)).alias("mean"),
            F.greatest(_or_zero(q - F.try_divide(s * s, n)), F.lit(0.0)).alias("squares"),
            low.alias("low"),
            high.alias("high"),
        )

    frames = (
        running(points, [*group, "__sign"], "__pos", sums, "__width", raw, limit)
        .where("__asks")
        .groupBy(*group, "__first", "__last", (F.col("__pos") * F.col("__sign")).alias("__at"))
        .agg(stats(1, "__first").alias("__head_stats"), stats(-1, "__last").alias("__tail_stats"))
        .drop("__first", "__last")
    )
    heads = rows.where(~tail)
    return join_groups(heads, frames, [*group, "__at"], "left").withColumn(
        name, _zscore(F.col("__v"), F.col("__head_stats"), F.col("__tail_stats"))
    )
