from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.functions.aggregates import Agg, finish_columns, merge_columns, partial_columns


def geo_rollup(df: DataFrame, levels: list[str], aggs: dict[str, Agg]) -> DataFrame:
    """Totals at each level of a hierarchy, coarsest first, and overall.

    ``grouping_id`` tells the levels apart: 0 is the finest, and a null in a
    level column of another row means "all".

    Rows are first reduced to the finest level, so the copies that a rollup
    makes for every level are made of groups rather than of input rows.
    """
    finest = df.groupBy(*levels).agg(*partial_columns(aggs))
    rolled = finest.rollup(*levels).agg(F.grouping_id().alias("grouping_id"), *merge_columns(aggs))
    return rolled.select(*levels, "grouping_id", *finish_columns(aggs))
