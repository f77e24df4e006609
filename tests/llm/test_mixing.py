import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frostgrid.llm.mixing import draw_slots, drawn_shard, mix_sources, permuted, source_targets
from frostgrid.sources import read_table

SCHEMA = "doc_id bigint, text string, source string, rank int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), factor=1.5):
    """Sources' shares by rounds of sharing out what is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = factor * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10}, {"a": 0}, {"a": 0, "b": 7, None: 1}, {"a": 1000, "b": 1, "c": 50, "é": 3, "z": 900, None: 40},
        {"s%d" % i: (i * 37) ** 2 % 1009 for i in range(60)},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in source_targets(df, [3.0, 1.0, 2.0]).collect()}
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select("id", F.lit(n).cast("bigint").alias("n"), F.lit(5).cast("bigint").alias("k"))
    images = [r.x for r in permuted(df, "id", "n", "k", "x").orderBy("id").collect()]
    assert sorted(images) == list(range(n))
    assert n < 100 or images != list(range(n))


def test_slots_of_shards(spark):
    sources = spark.createDataFrame([(0, 64_000, 90_000.0), (1, 3_200, 6_400.0), (2, 0, 0.0)], "rank bigint, source_size bigint, target double")
    slots = draw_slots(sources, block_words=32, shard_slots=500).collect()
    per = defaultdict(list)
    for r in slots:
        per[r.rank].append(r.slot)
    assert {k: sorted(v) for k, v in per.items()} == {0: list(range(2813)), 1: list(range(200))}
    times = defaultdict(int)
    for r in slots:
        times[r.rank, r.block] += 1
    assert {t for (k, _), t in times.items() if k == 0} == {1, 2}
    assert [times[1, b] for b in range(100)] == [2] * 100
    shard = defaultdict(int)
    for r in slots:
        shard[r.shard] += 1
    assert len(shard) == 7 and max(shard.values()) < 2 * min(shard.values())


def test_shards_are_drawn_evenly_and_apart(spark):
    """Counts of shard and source as of independent draws: near their mean, by about the root of it."""
    slots = spark.range(60_000).select(F.col("id") % 3, F.floor(F.col("id") / 3)).toDF("rank", "slot")
    drawn = slots.withColumn("shard", drawn_shard(F.col("rank"), F.col("slot"), F.lit(20)))
    counts = {(r.rank, r.shard): r["count"] for r in drawn.groupBy("rank", "shard").count().collect()}
    assert len(counts) == 60 and all(abs(n - 1000) < 5 * 1000**0.5 for n in counts.values())
    spread = sum((n - 1000) ** 2 / 1000 for n in counts.values())
    assert 25 < spread < 100
    same = drawn.alias("a").join(drawn.alias("b"), "slot").where("a.rank = 0 and b.rank = 1 and a.shard = b.shard").count()
    assert abs(same - 1000) < 5 * 1000**0.5


def check(df, rows):
    got = mix_sources(df, [3.0, 1.0, 2.0]).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(x["words"] for x in r.shards)
        assert [x["shard"] for x in r.shards] == sorted({x["shard"] for x in r.shards})
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 48 for s in sizes)
    again = mix_sources(df.repartition(3), [3.0, 1.0, 2.0]).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_odd_rows(spark):
    rows = [
        (1, None, "b"), (2, "", "b"), (3, "one", None), (3, "one", None), (None, "two words", "b"),
        (4, "w " * 5000, "a"), (5, "x y z", "é"), (6, "x\xa0y \x0b z", "z"), (7, "q r " * 300, None),
    ]
    check(frame(spark, rows), rows)
    assert mix_sources(frame(spark, rows).where("false"), [3.0, 1.0, 2.0]).count() == 0
    nothing = [(1, None, "a"), (2, " ", None)]
    check(frame(spark, nothing), nothing)


def test_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "documents")
    check(df, [(r.doc_id, r.text, r.source) for r in df.collect()])


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr("frostgrid.llm.common.BROADCAST_ROWS", 3)
    rows = [(i, "w " * (i % 40), f"s{i % 7}" if i % 3 else "hot") for i in range(500)]
    check(frame(spark, rows), rows)
