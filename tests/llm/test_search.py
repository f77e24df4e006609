import math
import os
import random

import numpy as np
import pytest

from frostgrid.llm.ann import CentroidGraph, balanced_centroids, nearest_neighbours
from frostgrid.llm.maxscore import Postings, inner_product_top_k
from frostgrid.llm.queries import QUERIES
from frostgrid.sources import read_table

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, shard string, rank int"
LARGE = "/root/testdata/check_l"
EVERY_20, EVERY_100 = "vec_id % 20 = 0", "vec_id % 100 = 0"


def usable(rows, nonzero):
    kept = {}
    for i, v in rows:
        ok = i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        if ok and (not nonzero or any(v)):
            v = np.array(v, np.float32).astype(np.float64).tolist()
            kept[i] = min(kept.get(i, v), v)
    return kept


def best_products(rows, every, k):
    floors = {i: [math.floor(64 * x) for x in v] for i, v in usable(rows, False).items()}
    out = []
    for q, a in floors.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in floors.items() if i != q)[:k]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def nearest(rows, every, k):
    points = usable(rows, True)
    out = {}
    for q, a in points.items():
        if q % every == 0:
            gap = lambda b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a + [0.0] * len(b), b + [0.0] * len(a))))
            out[q] = sorted((gap(b), i) for i, b in points.items() if i != q)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


ODD = [
    (0, [0.5, -0.25, 0.1]), (20, [0.5, -0.25, 0.1]), (20, [0.5, -0.25, 0.1]), (40, [1.0]), (60, []), (80, None),
    (100, [float("nan"), 1.0, 0.0]), (120, [None, 1.0, 0.0]), (140, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]),
    (1, [0.0, 0.0, 0.0]), (2, [0.5, -0.25, 0.1]), (3, [-1.0, 2.0, 0.3]), (4, [1.0, 2.0]), (160, [0.0, 0.0, 0.0]),
    (-20, [0.2, 0.2, 0.2]), (-100, [3.0, 2.0, 1.0]), (200, [3.0, 2.0, 1.0]),
]


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 3, "block_queries": 2}])
def test_products_of_odd_rows(spark, limits):
    got = inner_product_top_k(frame(spark, ODD), EVERY_20, 5, **limits).collect()
    assert sorted(map(tuple, got)) == best_products(ODD, 20, 5)
    assert inner_product_top_k(frame(spark, ODD).where("false"), EVERY_20).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(i, [2e7 + i * 512, 2e7 * (i % 3), 1.0]) for i in range(30)] + [(40, [4e7, 0.0, 0.0]), (41, [-4e7, 1.0, 0.0])]
    got = inner_product_top_k(frame(spark, rows), EVERY_20, 5).collect()
    assert sorted(map(tuple, got)) == best_products(rows, 20, 5)
    rows = [(0, [1e18]), (1, [1e18]), (2, [-1e18])]
    got = inner_product_top_k(frame(spark, rows), EVERY_20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


@pytest.mark.parametrize("seed", range(6))
def test_search_of_one_shard(seed):
    rng = np.random.default_rng(seed)
    impacts = np.floor(rng.normal(0, 6, (400, 24)) * (rng.random((400, 24)) < 0.5))
    ids = rng.permutation(1000)[:400]
    postings = Postings(ids, impacts)
    for q in range(20):
        found = list(zip(*(x.tolist() for x in postings.best(impacts[q], ids[q], 7))))
        wanted = sorted((-float(impacts[q] @ v), int(i)) for i, v in zip(ids, impacts) if i != ids[q])[:7]
        assert found == [(i, -s) for s, i in wanted]


def test_products_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF_DIR, "embeddings").collect()]
    assert sorted(map(tuple, QUERIES["op9_maxscore_top_k"](spark, SF_DIR).collect())) == best_products(rows, 20, 20)


def recall(got, rows, every, k):
    """Share of true neighbours found; checks that what is found is ranked and measured right."""
    wanted, points = nearest(rows, every, k), usable(rows, True)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == {q for q, best in wanted.items() if best}
    hits = 0
    for q, best in found.items():
        assert best == sorted(best) and len(best) == len(wanted[q]) == len({i for _, i in best})
        for score, i in best:
            a, b = (points[x] + [0.0] * 99 for x in (q, i))
            assert i != q and score == pytest.approx(math.dist(a[:99], b[:99]), rel=1e-12, abs=1e-12)
        hits += len({i for _, i in best} & {i for _, i in wanted[q]})
    return hits / max(sum(map(len, wanted.values())), 1)


@pytest.mark.parametrize("limits", [{}, {"list_rows": 2, "chunk_rows": 2}])
def test_neighbours_of_odd_rows(spark, limits):
    got = nearest_neighbours(frame(spark, ODD), EVERY_100, 4, **limits).collect()
    assert recall(got, ODD, 100, 4) >= 0.9
    assert nearest_neighbours(frame(spark, ODD).where("false"), EVERY_100).count() == 0
    assert nearest_neighbours(frame(spark, ODD[:1]), EVERY_100).count() == 0


def test_many_copies_of_one_vector(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    got = nearest_neighbours(frame(spark, rows), EVERY_100, 10, chunk_rows=50).collect()
    assert recall(got, rows, 100, 10) >= 0.9


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, scale):
    sf_dir = f"/root/testdata/{scale}"
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, sf_dir, "embeddings").collect()]
    assert recall(QUERIES["op10_nearest_neighbours"](spark, sf_dir).collect(), rows, 100, 10) >= 0.95


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="the larger tables of the check tool are not there")
def test_recall_on_fifty_thousand_vectors(spark):
    """Held against all distances in blocks, on a table of several hundred lists."""
    vectors = spark.read.parquet(f"{LARGE}/embeddings.parquet").where("vec_id is not null and embedding is not null")
    found = {}
    for r in nearest_neighbours(vectors, EVERY_100).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    rows = {i: v for i, v in rows.items() if all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(rows))
    points = np.array([rows[i] for i in ids.tolist()], np.float64)
    asking = np.nonzero(ids % 100 == 0)[0]
    assert len(ids) > 50_000 and set(found) == set(ids[asking].tolist())
    hits, squares = 0, (points**2).sum(axis=1)
    for at in range(0, len(asking), 64):
        block = asking[at:at + 64]
        gaps = squares - 2 * points[block] @ points.T
        gaps[np.arange(len(block)), block] = np.inf
        for q, best in zip(block, np.argpartition(gaps, 9, axis=1)[:, :10]):
            hits += len(found[ids[q]] & set(ids[best].tolist()))
    assert hits >= 0.92 * 10 * len(asking)


def test_walks_end_at_the_point_itself():
    points = np.random.default_rng(3).random((4000, 3))
    row, node, distance = CentroidGraph(points).within(points[:200], 1.0, beam=4)
    assert row.tolist() == node.tolist() == list(range(200)) and not distance.any()


def test_graph_finds_what_a_scan_finds():
    points = np.random.default_rng(2).normal(size=(3000, 16))
    centroids = balanced_centroids(points, 200)
    row, node, _ = CentroidGraph(centroids).within(points[:50], 1.15)
    distance = np.sqrt(((points[:50, None] - centroids[None]) ** 2).sum(axis=2))
    wanted = set(zip(*(x.tolist() for x in np.nonzero(distance <= 1.15 * distance.min(axis=1, keepdims=True)))))
    assert len(wanted & set(zip(row.tolist(), node.tolist()))) >= 0.98 * len(wanted)
