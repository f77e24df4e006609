import math

import numpy as np
import pytest

from frostgrid.llm import hard_negatives as module
from frostgrid.llm.hard_negatives import hard_negatives, spanning_tree
from frostgrid.llm.queries import QUERIES
from frostgrid.sources import read_table

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, score string, positives string"
EVERY_50 = "vec_id % 50 = 0"
SMALL = {"block_anchors": 2, "chunk_rows": 3}


def brute(rows, every=50, positives=5, negatives=3):
    kept = {}
    for i, v, label in rows:
        if None in (i, label) or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = np.array(v, np.float32).astype(np.float64).tolist()
        kept[i] = min(kept.get(i, (v, label)), (v, label))
    floors = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in kept.items()}
    out = []
    for a, (va, la) in floors.items():
        if a % every:
            continue
        scores = [
            (-sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in floors.items() if i != a
        ]
        scores.sort()
        for p, i, _ in [s for s in scores if s[2] == la][:positives]:
            hard = [(n, j) for n, j, label in scores if label != la and -50 * p <= -100 * n <= -95 * p]
            out += [(a, i, rank + 1, j, -p, -n) for rank, (n, j) in enumerate(hard[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", "y") for i, v, label in rows], SCHEMA)


ODD = [
    (0, [0.5, -0.25, 0.1], 1), (50, [0.5, -0.25, 0.1], 1), (50, [0.5, -0.25, 0.1], 1), (50, [0.6, 0.1, 0.0], 2),
    (100, [1.0], 3), (150, [], 3), (200, None, 1), (250, [0.5, 0.5, 0.5], None), (300, [float("nan"), 1.0], 1),
    (350, [None, 1.0], 1), (None, [1.0, 1.0], 1), (400, [0.0, 0.0, 0.0], 3), (-50, [0.2, 0.2, 0.2], 2),
    *[(i, [0.4, -0.2, 0.1 * (i % 3)], 1 + i % 4) for i in range(1, 40)], (41, [-0.4, 0.2, -0.1], 1),
]


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_odd_rows(spark, limits):
    expected = brute(ODD)
    assert expected
    assert sorted(map(tuple, hard_negatives(frame(spark, ODD), EVERY_50, **limits).collect())) == expected
    assert hard_negatives(frame(spark, ODD).where("false"), EVERY_50, **limits).count() == 0
    assert hard_negatives(frame(spark, ODD), "vec_id = 1000", **limits).count() == 0


@pytest.mark.parametrize("limits", [{}, {"block_anchors": 16, "chunk_rows": 100}])
def test_crowded_vectors(spark, limits):
    """Clusters tight enough for the bounds to leave candidates out, and a third of all rows one vector."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = []
    for i in range(1500):
        v = centres[0] if i % 3 == 0 else centres[i % 8] + 0.05 * rng.normal(size=12)
        rows.append((i, v.tolist(), int(rng.integers(0, 4))))
    expected = brute(rows)
    assert sorted(map(tuple, hard_negatives(frame(spark, rows), EVERY_50, **limits).collect())) == expected


def test_scores_beyond_doubles(spark):
    rows = [(i * 10, [2e6 + i * 512, 2e6 * (i % 3), 1.0], i % 2) for i in range(30)]
    assert sorted(map(tuple, hard_negatives(frame(spark, rows), EVERY_50).collect())) == brute(rows) != []
    rows = [(0, [1e18], 1), (1, [1e18], 1), (2, [-1e18], 1), (3, [1e-3], 2), (4, [0.1], 2), (5, [0.2], 2)]
    most = 2**63 - 1
    got = [tuple(r) for r in hard_negatives(frame(spark, rows), EVERY_50).collect()]
    assert [(a, p, s) for a, p, _, _, s, _ in got if p == 1] == [(0, 1, most)] * len([r for r in got if r[1] == 1])


def test_bounds_save_scoring(monkeypatch):
    """On tight clusters most candidates are never scored for most anchors."""
    import pandas as pd

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16)) * 200
    points = np.floor(centres[np.arange(4000) % 10] + rng.normal(size=(4000, 16)) * 4)
    chunk = pd.DataFrame({"vec_id": np.arange(4000), "label": np.arange(4000) % 10, "vector": list(points)})
    block = chunk[chunk["vec_id"] % 50 == 0]
    order, parent, edge = spanning_tree(np.stack(block["vector"].to_list()))
    block = block.iloc[order].assign(parent=parent, edge=edge)
    scored = []
    rescore = module.Candidates.rescore
    monkeypatch.setattr(
        module.Candidates, "rescore", lambda self, a, wanted, c, r: (scored.append(wanted.sum()), rescore(self, a, wanted, c, r))[1]
    )
    found = module.positives_of(block, chunk, lambda column: np.stack(column.to_list()).astype(float), 5)
    for a, group in pd.DataFrame(found, columns=["a", "i", "s"]).groupby("a"):
        same = np.nonzero((np.arange(4000) % 10 == a % 10) & (np.arange(4000) != a))[0]
        scores = points[same] @ points[a]
        wanted = sorted(zip(-scores, same))[:5]
        assert sorted(zip(-group["s"], group["i"])) == wanted
    assert sum(scored) < 0.1 * 4000 * len(block)


def test_tree_is_minimal_and_parents_come_first():
    points = np.random.default_rng(6).normal(size=(60, 3))
    order, parent, edge = spanning_tree(points)
    assert sorted(order) == list(range(60)) and parent[0] == -1 and (parent[1:] < np.arange(1, 60)).all()
    assert np.allclose(edge[1:], np.linalg.norm(points[order[1:]] - points[order[parent[1:]]], axis=1))
    gaps = sorted((math.dist(points[i], points[j]), i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0
    for gap, i, j in gaps:
        if root[i] != root[j]:
            total += gap
            root = [root[j] if r == root[i] else r for r in root]
    assert edge.sum() == pytest.approx(total)
    assert [len(x) for x in spanning_tree(np.zeros((0, 3)))] == [0, 0, 0]


def test_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [
        (r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in read_table(spark, sf_dir, "embeddings").collect()
    ]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, sf_dir).collect())) == brute(rows)
