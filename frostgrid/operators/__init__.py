"""Operators on batch DataFrames."""

from frostgrid.operators.asof import as_of_join
from frostgrid.operators.gaps import gap_fill
from frostgrid.operators.overlap import overlap_counts, overlap_join
from frostgrid.operators.quantiles import quantile_profile
from frostgrid.operators.resample import resample
from frostgrid.operators.rolling import rolling_zscore
from frostgrid.operators.rollup import geo_rollup
from frostgrid.operators.sessions import sessionize
from frostgrid.operators.spells import threshold_spells
from frostgrid.operators.topk import top_k

__all__ = [
    "as_of_join", "gap_fill", "geo_rollup", "overlap_counts", "overlap_join", "quantile_profile",
    "resample", "rolling_zscore", "sessionize", "threshold_spells", "top_k",
]
