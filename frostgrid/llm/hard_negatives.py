"""Hard negatives by exact search, bounded along spanning trees over the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, join_lookup, tasks
from frostgrid.llm.vectors import as_matrix

BLOCK_ANCHORS = 4096
CHUNK_ROWS = 32768
LEAST_CHUNK = 2048
# Candidates whose bounds are held for the anchors on the way down a tree.
STEP_ROWS = 2048
MOST_BITS = 12
LEAST, MOST = -(2**63), 2**63 - 1


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree: the points in an order with parents first, the parent's place there, the edge's length.

    The root's parent is -1. Of the children of a point the one with the most
    points below it comes last, so that on a walk in this order a parent with
    children still to come is on at most logarithmically many levels at once.
    """
    n = len(points)
    points = points.astype(np.float64)
    parent, edge = np.full(n, -1), np.full(n, np.inf)
    outside, added = np.ones(n, bool), np.zeros(n, np.int64)
    at = 0
    for step in range(n):
        added[step], outside[at] = at, False
        distance = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        nearer = outside & (distance < edge)
        parent[nearer], edge[nearer] = at, distance[nearer]
        at = int(np.where(outside, edge, np.inf).argmin())
    # Points at a distance beyond doubles hang on the root, at an infinite edge.
    parent[(parent < 0) & (np.arange(n) > 0)] = 0
    below = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in added[:0:-1]:
        below[parent[i]] += below[i]
        children[parent[i]].append(int(i))
    order, stack = [], [0] if n else []
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(children[i], key=lambda c: (-below[c], c))
    place = np.zeros(n, np.int64)
    place[order] = np.arange(n)
    edge[0:1] = 0.0
    return np.array(order, np.int64), np.where(parent[order] < 0, -1, place[parent[order]]), edge[order]


class Candidates:
    """Some candidates and, for the anchors above the present one, what is known of their scores.

    ``centre`` plus or minus ``radius`` holds every candidate's score. It is handed from an
    anchor to its child with a radius wider by the length of the edge times the
    candidate's norm, since the scores differ by the product of the candidate and the edge.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def below(self, parent: int, edge: float, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """Centre and radius for a child of the anchor at place ``parent``, its ``last`` one or not."""
        if parent < 0 or not np.isfinite(edge):
            return np.zeros(len(self.ids)), np.full(len(self.ids), np.inf)
        centre, radius = self.known.pop(parent) if last else self.known[parent]
        # A score cut to the ends of a bigint says nothing exact about the next.
        radius = np.where(np.abs(centre) < 2.0**63, radius + edge * self.norms, np.inf)
        return centre if last else centre.copy(), radius

    def rescore(self, anchor: np.ndarray, wanted: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple:
        """Places and exact scores of the wanted candidates, whose centre and radius change in place."""
        places = np.nonzero(wanted)[0]
        if 2 * len(places) > len(wanted):
            scores = _as_bigint(self.vectors @ anchor)
            centre[:], radius[:] = scores, 0.0
            return places, scores[places]
        scores = _as_bigint(self.vectors[places] @ anchor)
        centre[places], radius[places] = scores, 0.0
        return places, scores


def _as_bigint(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a bigint as its ends; only numbers that are not doubles can be that large."""
    return np.clip(scores, LEAST, MOST) if scores.dtype == object else scores


def _ends(centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores, a little wider than the rounding of doubles may make them."""
    margin = 1e-9 * (np.abs(centre) + radius) + 1e-3
    return centre - radius - margin, centre + radius + margin


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.nonzero(scores >= -np.partition(-scores, k - 1)[k - 1])[0]
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Ranked:
    """The ``k`` best found so far within a range of scores, from both sides included."""

    def __init__(self, k: int, low: int = LEAST, high: int = MOST):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def put(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        ids, scores = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.scores, scores[inside]])
        first = _first(ids, scores, self.k)
        self.ids, self.scores = ids[first], scores[first]
        if len(first) == self.k:
            self.low = self.scores[-1]


def _walk(block: pd.DataFrame, chunk: pd.DataFrame, matrix) -> Iterator[tuple]:
    """For each step of candidates and each anchor, parents first: (place, candidates, centre, radius, vector)."""
    vectors, anchors = matrix(chunk["vector"]), matrix(block["vector"])
    ids, labels = chunk["vec_id"].to_numpy(), chunk["label"].to_numpy()
    parents, edges = block["parent"].to_numpy(), block["edge"].to_numpy()
    last_child = {parent: place for place, parent in enumerate(parents.tolist())}
    for at in range(0, len(ids), STEP_ROWS):
        step = slice(at, at + STEP_ROWS)
        some = Candidates(ids[step], labels[step], vectors[step])
        for place, (parent, edge) in enumerate(zip(parents.tolist(), edges.tolist())):
            centre, radius = some.below(parent, edge, last_child.get(parent) == place)
            yield place, some, centre, radius, anchors[place]
            if place in last_child:
                some.known[place] = centre, radius


def positives_of(block: pd.DataFrame, chunk: pd.DataFrame, matrix, k: int) -> list[tuple]:
    """(anchor, candidate, score) of the ``k`` best candidates of each anchor's own label."""
    anchor_ids, anchor_labels = block["vec_id"].to_list(), block["label"].to_list()
    best = [Ranked(k) for _ in anchor_ids]
    for place, some, centre, radius, anchor in _walk(block, chunk, matrix):
        same = (some.labels == anchor_labels[place]) & (some.ids != anchor_ids[place])
        low, high = _ends(centre, radius)
        least = low[same]
        # The k-th best score is no less than the k-th best of the lower ends.
        reach = -np.partition(-least, k - 1)[k - 1] if len(least) >= k else -np.inf
        wanted = same & (high >= max(float(best[place].low), reach))
        places, scores = some.rescore(anchor, wanted, centre, radius)
        best[place].put(some.ids[places], scores)
    return [(a, i, s) for a, found in zip(anchor_ids, best) for i, s in zip(found.ids.tolist(), found.scores.tolist())]


def negatives_of(block: pd.DataFrame, chunk: pd.DataFrame, matrix, k: int, lowest: int, highest: int) -> list[tuple]:
    """(anchor, positive, positive's score, candidate, score) of the ``k`` best within the window of each positive."""
    anchor_ids, anchor_labels = block["vec_id"].to_list(), block["label"].to_list()
    windows = [
        [
            (int(i), int(s), Ranked(k, -(-lowest * int(s) // 100), highest * int(s) // 100))
            for i, s in ([] if of is None else of)
        ]
        for of in block["positives"]
    ]
    for place, some, centre, radius, anchor in _walk(block, chunk, matrix):
        open_windows = [found for _, _, found in windows[place] if found.low <= found.high]
        if not open_windows:
            continue
        low, high = _ends(centre, radius)
        overlaps = np.zeros(len(low), bool)
        for found in open_windows:
            overlaps |= (high >= float(found.low)) & (low <= float(found.high))
        places, scores = some.rescore(anchor, overlaps & (some.labels != anchor_labels[place]), centre, radius)
        for found in open_windows:
            found.put(some.ids[places], scores)
    return [
        (a, i, s, c, x)
        for a, of in zip(anchor_ids, windows) for i, s, found in of
        for c, x in zip(found.ids.tolist(), found.scores.tolist())
    ]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 3, lowest: int = 50,
    highest: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block_anchors: int = BLOCK_ANCHORS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives, the ``negatives`` hardest rows of other labels.

    Components count as ``floor(scale * x)``; a row's score is its inner product
    with the anchor, higher first, ties to the smaller id. Anchors are the rows
    that meet ``is_anchor``, a condition on ``vec_id``. An anchor's positives are
    its first ``positives`` other rows of its label (all, if fewer). Negatives
    are rows of another label whose score is between ``lowest`` and ``highest``
    hundredths of the positive's, both included; so a positive below zero has none.
    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``.

    Rows without id, label or vector, or with a component that is null or not
    finite, take no part. Of rows with one id the smallest vector, then the
    smallest label stays. Shorter vectors count as if zeros followed. Scores
    beyond a bigint count as its ends. An empty table gives no rows.

    Anchors form blocks of about ``block_anchors`` by the signs of their first
    components, crowded signs dealt out by a hash; each block has a spanning
    tree. Every block meets every chunk of candidates in a task of its own,
    which walks the tree: a parent's scores bound its child's, and only
    candidates are scored whose bounds reach the best found so far, or the
    window. A task sends on the best of its chunk only. Positives are settled
    over all chunks first, negatives in a second pass.
    """
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    slim = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), value.alias("vector"), F.col(label_col).cast("bigint").alias("label")
    )
    slim = slim.where("vec_id is not null and label is not null and vector is not null").where(finite)
    once = slim.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("row")).select("vec_id", "row.*")
    floors = F.transform("vector", lambda x: F.floor(F.lit(scale) * x))
    rows = checkpointed(once.withColumn("vector", floors))
    condition = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    largest_part = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))
    n, width, largest, asking = rows.agg(
        F.count("*"), F.max(F.size("vector")), largest_part, F.count_if(condition)
    ).collect()[0]
    width, largest = width or 0, float(largest or 0)
    # Doubles hold sums of products exactly up to 2 ** 53.
    dtype = np.float64 if width * largest**2 < 2**53 else object
    kind = next(t for t, most in (("smallint", 2**15), ("int", 2**31), ("bigint", np.inf)) if largest < most)
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))

    def matrix(column: pd.Series) -> np.ndarray:
        if dtype is object:
            return as_matrix(column.map(lambda v: np.array([int(x) for x in v], object)), width, object)
        return as_matrix(column, width)

    # Signs of the first components, for about one block per code.
    bits = min(max((asking // block_anchors).bit_length(), 0), MOST_BITS)
    code = F.lit(0)
    for bit in range(bits):
        code = code + F.when(F.coalesce(F.get("vector", F.lit(bit)), F.lit(0)) > 0, 1 << bit).otherwise(0)
    coded = rows.where(condition).withColumn("code", code)
    # At most 2 ** MOST_BITS numbers.
    sizes = coded.groupBy("code").count().orderBy("code").collect()
    parts = [-(-r["count"] // block_anchors) for r in sizes]
    starts = np.cumsum([0, *parts]).tolist()
    blocks = max(starts[-1], 1)
    spark = vectors.sparkSession
    of_code = spark.createDataFrame(
        [(r["code"], start, part) for r, start, part in zip(sizes, starts, parts)], "code int, start int, parts int"
    )
    own_block = (F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    in_blocks = join_lookup(coded, of_code, "code", F.col("vec_id"), "inner").withColumn("block", own_block)

    def planted(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        order, parent, edge = spanning_tree(matrix(block["vector"]))
        return block.iloc[order].assign(place=np.arange(len(order)), parent=parent, edge=edge)

    tree = f"block int, vec_id bigint, label bigint, vector array<{kind}>, place bigint, parent bigint, edge double"
    anchors = checkpointed(
        in_blocks.select("block", "vec_id", "label", "vector").groupBy("block").applyInPandas(planted, tree)
    )

    cells = max(tasks(spark), 1)
    of_chunk = max(min(chunk_rows, -(-n * blocks // cells)), min(chunk_rows, LEAST_CHUNK))
    chunks = max(-(-n // of_chunk), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))

    def in_cells(trees: DataFrame, search, schema: str) -> DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]

        def cell(chunk: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            found = search(block.sort_values("place"), chunk, matrix) if len(chunk) and len(block) else []
            whole = [[int(x) for x in row] for row in found]
            return pd.DataFrame(whole, columns=names).astype("int64")

        sent = trees.withColumn("chunk", every(chunks))
        return dealt.groupBy("block", "chunk").cogroup(sent.groupBy("block", "chunk")).applyInPandas(cell, schema)

    near = in_cells(
        anchors, lambda block, chunk, m: positives_of(block, chunk, m, positives), "vec_id bigint, id bigint, score bigint"
    )
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "id"))
    listed = near.withColumn("rank", rank).where(F.col("rank") <= positives)
    # At most ``positives`` of each anchor.
    of_anchor = listed.groupBy("vec_id").agg(F.collect_list(F.array("id", "score")).alias("positives"))
    asked = anchors.join(checkpointed(of_anchor), "vec_id", "left")
    hard = in_cells(
        asked, lambda block, chunk, m: negatives_of(block, chunk, m, negatives, lowest, highest),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
