"""Rolling scores, quantiles, rollups, top-k and running values against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostgrid.functions import count, high, mean, total
from frostgrid.operators import geo_rollup, quantile_profile, rolling_zscore, top_k, topk
from frostgrid.operators.running import running
from tests.frames import at, frame, ordered, rows_of

READINGS = "id bigint, key string, ts timestamp_ntz, value double"


def zscores(rows, lookback):
    out = []
    for i, key, ts, value in rows:
        score = None
        if ts is not None and value is not None:
            framed = [
                v for _, k, t, v in rows
                if k == key and t is not None and v is not None and ts - lookback <= t <= ts
            ]
            if len(framed) > 1 and len(set(framed)) > 1:
                score = (value - statistics.fmean(framed)) / statistics.stdev(framed)
        out.append((i, key, ts, value, score))
    return out


def random_readings(seed, n=250):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["a", "a", "b", None]), at(rng.randrange(-50, 150)), rng.choice([None, 1.0, 2.5, 1e6, 0.1]))
        for i in range(n)
    ]
    rows += [(1000 + i, "c", at(3 * i), 0.1) for i in range(20)]  # no deviation at all
    rows += [(2000 + i, "a", at(100 + i * 1e-6), float(i % 7)) for i in range(120)]  # a bunch
    return rows + [(3000, "a", None, 1.0), (3001, "d", at(5), 1.0)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 60, 4])
def test_rolling_zscore(spark, hot_rows):
    rows = random_readings(4)
    df = frame(spark, READINGS, rows)
    got = rolling_zscore(df, "ts", ["key"], "value", "20 seconds", hot_rows=hot_rows)
    assert got.columns == [*df.columns, "zscore"]
    assert rows_of(got, 7) == ordered(zscores(rows, at(20) - at(0)), 7)


def test_rolling_zscore_after_a_large_value(spark):
    """Values that leave the frame leave no rounding error behind."""
    rows = [(0, "a", at(0), 1e12)] + [(i, "a", at(10 + i), 1.0 + i * 1e-3) for i in range(1, 6)]
    for hot_rows in (1_000_000, 1):
        got = rolling_zscore(frame(spark, READINGS, rows), "ts", ["key"], "value", "8 seconds", hot_rows=hot_rows)
        last = {r.id: r.zscore for r in got.collect()}
        assert math.isclose(last[5], 2 / statistics.stdev([1, 2, 3, 4, 5]), rel_tol=1e-9)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running(spark, width):
    rng = random.Random(width)
    positions = rng.sample(range(-500, 500), 120) + list(range(2000, 2080))
    rows = [("a" if p % 3 else None, p, rng.choice([None, rng.randrange(100)]), width) for p in positions]
    df = frame(spark, "key string, pos bigint, x bigint, width bigint", rows)
    df = df.withColumns({"least": F.col("x"), "most": F.col("x"), "latest": F.col("x")})
    fns = {"x": "sum", "least": "min", "most": "max", "latest": "last"}
    got = running(df, ["key"], "pos", fns, "width", df, limit=10)
    expected = []
    for key in ("a", None):
        seen = []
        for _, p, x, _ in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            seen += [x] if x is not None else []
            known = (sum(seen), min(seen), max(seen), seen[-1]) if seen else (None,) * 4
            expected.append((key, p, *known))
    assert rows_of(got.select("key", "pos", *fns)) == ordered(expected)


PROBS = [0.0, 0.05, 0.5, 0.95, 1.0]


def random_groups(seed):
    rng = random.Random(seed)
    rows = [("few", float(rng.randrange(100))) for _ in range(6)]
    rows += [("many", rng.gauss(0, 1)) for _ in range(900)]
    rows += [("tied", rng.choice([1.0, 2.0])) for _ in range(300)]
    rows += [(None, rng.random()) for _ in range(200)] + [("null", None)] * 80 + [("many", None)] * 50
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 250, 70, 3])
def test_quantile_profile(spark, hot_rows):
    rows = random_groups(6)
    df = frame(spark, "key string, value double", rows)
    got = quantile_profile(df, ["key"], "value", PROBS, hot_rows=hot_rows)
    assert got.columns == ["key", "p0", "p5", "p50", "p95", "p100"]
    expected = []
    for key in {r[0] for r in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        found = np.quantile(values, PROBS).tolist() if values else [None] * len(PROBS)
        expected.append((key, *found))
    assert rows_of(got) == ordered(expected)


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_quantile_profile_of_everything(spark, hot_rows):
    rows = random_groups(7)
    got = quantile_profile(frame(spark, "key string, value double", rows), [], "value", [0.125], hot_rows=hot_rows)
    assert got.columns == ["p12_5"]
    expected = np.quantile([v for _, v in rows if v is not None], 0.125)
    assert math.isclose(got.first()[0], expected)


@pytest.mark.parametrize("hot_rows", [500, 30])
def test_quantiles_do_not_depend_on_the_size_of_groups(spark, hot_rows):
    rng = random.Random(12)
    inf, nan = math.inf, math.nan
    rows = [("inf", x) for x in [1.5] * 1000 + [inf] * 1000] + [("both", x) for x in [-inf] * 700 + [inf] * 701]
    rows += [("nan", nan if i % 10 else rng.random()) for i in range(1500)] + [("all nan", nan)] * 900
    rows += [("gauss", rng.gauss(0, 1)) for _ in range(3000)] + [("tied", float(i % 3)) for i in range(2000)]
    rows += [("null", None)] * 600 + [("null", 4.0)] + [("one", 7.0)] + [("some nan", nan if i % 50 == 0 else i / 7) for i in range(3000)]
    rows += [("zeros", -0.0 if i % 2 else 0.0) for i in range(800)]
    probs = [0.0, 0.1, 0.33, 0.5, 0.77, 0.9, 0.979, 1.0]
    df = frame(spark, "key string, value double", rows)
    cold = sorted(map(repr, quantile_profile(df, ["key"], "value", probs).collect()))
    assert sorted(map(repr, quantile_profile(df, ["key"], "value", probs, hot_rows=hot_rows).collect())) == cold
    whole = spark.range(3000).select(F.lit("k").alias("key"), (F.lit(2**60) + F.col("id")).alias("value"))
    cold = quantile_profile(whole, ["key"], "value", probs).collect()
    assert quantile_profile(whole, ["key"], "value", probs, hot_rows=hot_rows).collect() == cold


@pytest.mark.parametrize("exact", [True, False])
def test_quantiles_of_nothing(spark, exact):
    none = frame(spark, "key string, value double", [])
    assert [tuple(r) for r in quantile_profile(none, [], "value", [0.5], exact=exact).collect()] == [(None,)]
    assert quantile_profile(none, ["key"], "value", [0.5], exact=exact).count() == 0


def test_approximate_quantiles_keep_their_bound(spark):
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("value"))
    values = np.sort([r.value for r in df.collect()])
    got = quantile_profile(df.withColumn("key", F.lit(1)), ["key"], "value", PROBS, exact=False, accuracy=1_000)
    for p, v in zip(PROBS, got.drop("key").first()):
        assert abs(np.searchsorted(values, v) - p * len(values)) <= len(values) / 1_000 + 1


def test_geo_rollup(spark):
    rows = [("n", "x", 1.0), ("n", "x", 2.0), ("n", None, 4.0), (None, "y", 8.0), ("s", "x", None)]
    got = geo_rollup(
        frame(spark, "region string, nation string, value double", rows), ["region", "nation"],
        {"n": count(), "s": total("value"), "m": mean("value"), "hi": high("value")},
    )
    assert rows_of(got) == ordered([
        ("n", "x", 0, 2, 3.0, 1.5, 2.0), ("n", None, 0, 1, 4.0, 4.0, 4.0), (None, "y", 0, 1, 8.0, 8.0, 8.0),
        ("s", "x", 0, 1, None, None, None),
        ("n", None, 1, 3, 7.0, 7 / 3, 4.0), (None, None, 1, 1, 8.0, 8.0, 8.0), ("s", None, 1, 1, None, None, None),
        (None, None, 3, 5, 15.0, 3.75, 8.0),
    ])


@pytest.mark.parametrize("one_step_k", [32, 2])
def test_top_k(spark, monkeypatch, one_step_k):
    monkeypatch.setattr(topk, "ONE_STEP_K", one_step_k)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), at(0), float(rng.randrange(5))) for i in range(100)]
    rows.append((100, "c", at(0), None))
    df = frame(spark, READINGS, rows).repartition(5)
    got = rows_of(top_k(df, ["key"], [F.desc("value"), F.asc("id")], 7).select("key", "id", "rank"))
    expected = []
    for key in ("a", "b", None, "c"):
        best = sorted((r for r in rows if r[1] == key), key=lambda r: (-(r[3] or 0.0), r[0]))[:7]
        expected += [(key, r[0], n + 1) for n, r in enumerate(best)]
    assert got == ordered(expected)
