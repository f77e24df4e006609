"""Approximate nearest neighbours with balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed
from frostgrid.llm.vectors import as_matrix, whole_vectors

SAMPLE_ROWS = 65_536
LIST_ROWS = 64
MOST_CENTROIDS = 16_384
NEIGHBOURS = 24
BEAM = 8
COPIES = 2
COPY_RATIO = 1.1
SEARCH_RATIO = 1.16
CHUNK_ROWS = 8192


def balanced_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Means of ``count`` parts of nearly the same size: halves by two means, halved again."""
    rng = np.random.default_rng(7)
    parts, done = [sample], []
    while parts:
        part = parts.pop()
        if len(part) <= max(len(sample) / count, 1):
            done.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = part @ (a - b)
            order = np.argsort(side, kind="stable")
            low, high = part[order[:len(part) // 2]], part[order[len(part) // 2:]]
            a, b = high.mean(axis=0), low.mean(axis=0)
        parts += [low, high]
    # In the order of halving, so that neighbours in number are mostly neighbours.
    centroids = np.array(done)
    _, first = np.unique(centroids, axis=0, return_index=True)
    return centroids[np.sort(first)]


class CentroidGraph:
    """Centroids in memory, each linked to its nearest ones and to some at random."""

    def __init__(self, centroids: np.ndarray):
        self.points = centroids.astype(np.float32)
        n = len(centroids)
        rng = np.random.default_rng(11)
        near = min(NEIGHBOURS, n)
        self.links = np.zeros((n, near + 4), np.int32)
        squares = (self.points**2).sum(axis=1)
        for at in range(0, n, 512):
            d = squares[None, :] - 2 * self.points[at:at + 512] @ self.points.T
            self.links[at:at + 512, :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        self.links[:, near:] = rng.integers(0, n, (n, 4))
        self.entries = rng.choice(n, min(16, n), replace=False)

    def within(self, queries: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, centroid, distance) of centroids at most ``ratio`` times as far as the nearest found.

        A walk from fixed entries: of each query all centroids are expanded
        that are within the ratio or among its ``beam`` nearest so far.
        Only centroids that the walk comes to are measured and kept, so that its
        cost does not depend on how many there are.
        """
        queries = queries.astype(np.float32)
        n, m = len(queries), len(self.points)
        nearest = np.full((n, beam), np.inf, np.float32)
        row, node = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)
        # What was come to, sorted by query and centroid, with distance and whether it was expanded.
        seen, distance, expanded = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
        while len(row):
            new = np.sqrt(((queries[row] - self.points[node]) ** 2).sum(axis=1))
            by_row = np.lexsort((new, row))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < beam
            best = np.full((n, beam), np.inf, np.float32)
            best[row[first], place[first]] = new[by_row][first]
            nearest = np.sort(np.concatenate([nearest, best], axis=1), axis=1)[:, :beam]
            limit = np.maximum(nearest[:, 0] * np.float32(ratio), nearest[:, min(beam, m) - 1])
            order = np.argsort(np.concatenate([seen, row * m + node]), kind="stable")
            seen = np.concatenate([seen, row * m + node])[order]
            distance = np.concatenate([distance, new])[order]
            expanded = np.concatenate([expanded, np.zeros(len(row), bool)])[order]
            chosen = np.nonzero(~expanded & (distance <= limit[seen // m]))[0]
            expanded[chosen] = True
            reached = (seen[chosen] // m * m)[:, None] + self.links[seen[chosen] % m]
            reached = np.unique(reached)
            at = np.searchsorted(seen, reached)
            fresh = reached[seen[np.minimum(at, len(seen) - 1)] != reached]
            row, node = fresh // m, fresh % m
        row, node = seen // m, seen % m
        within = distance <= nearest[row, 0] * np.float32(ratio)
        return row[within], node[within], distance[within]


def nearest_neighbours(
    vectors: DataFrame, is_query: Column | str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, search_ratio: float = SEARCH_RATIO,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The ``k`` nearest other vectors found for each query, by Euclidean distance.

    Queries are the rows of ``vectors`` that meet ``is_query``, a condition on
    ``vec_id``. Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the exact
    distance in double precision; ties go to the smaller id. Zero vectors and
    those that :func:`whole_vectors` leaves out take no part; shorter vectors
    count as if zeros followed.

    Centroids are fitted to a sample of about ``sample_rows`` rows, one for each
    ``list_rows`` rows of the table, at most ``MOST_CENTROIDS`` and a quarter of the sample.
    Every row is then indexed: it goes to the list of its nearest centroid and,
    near a border, to a second one at most ``COPY_RATIO`` times as far. A query reads
    the lists of all centroids at most ``search_ratio`` times as far as its nearest. Both find
    centroids by walking a graph held in memory. Neighbouring lists are searched
    in one task, which sends on at most ``k`` rows per query; where they hold more than
    ``chunk_rows`` rows they are cut into chunks that are searched apart. If a query finds fewer than ``k`` rows there, all rows
    are searched for it.
    """
    rows = checkpointed(whole_vectors(vectors, id_col, vector_col, nonzero=True))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).collect()[0]
    if not n:
        return _ranked(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    chosen = rows.where(hashed < F.lit(int((1 << 30) * min(sample_rows / n, 1.0)))).orderBy("vec_id")
    sample = _matrix_of(chosen, width)
    if not len(sample):
        sample = _matrix_of(rows.orderBy("vec_id").limit(1), width)
    count = max(min(n // list_rows, MOST_CENTROIDS, len(sample) // 4), 1)
    graph = CentroidGraph(balanced_centroids(sample, count))
    queries = rows.where(is_query)

    lists_per_task = max(chunk_rows // (list_rows * COPIES), 1)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                row, node, distance = graph.within(as_matrix(part["vector"], width), COPY_RATIO)
                order = np.lexsort((node, distance, row))
                row, node = row[order], node[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < COPIES
                row, node = row[keep], node[keep]
                out = part.iloc[row].copy()
                out["list"] = node.astype(np.int64)
                out["task"] = out["list"] // lists_per_task
                yield out[["task", "list", "vec_id", "vector"]]

    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                row, node, _ = graph.within(as_matrix(part["vector"], width), search_ratio)
                lists = pd.DataFrame({"row": row, "task": node // lists_per_task, "list": node})
                of_task = lists.groupby(["row", "task"])["list"].agg(list).reset_index()
                out = part.iloc[of_task["row"].to_numpy()].copy()
                out["task"], out["lists"] = of_task["task"].to_numpy(), of_task["list"].to_list()
                yield out[["task", "lists", "vec_id", "vector"]]

    members = checkpointed(rows.mapInPandas(listed, "task bigint, list bigint, vec_id bigint, vector array<double>"))
    readers = queries.mapInPandas(reading, "task bigint, lists array<bigint>, vec_id bigint, vector array<double>")
    # At most MOST_CENTROIDS numbers.
    chunks = np.ones(len(graph.points) // lists_per_task + 1, np.int64)
    for row in members.groupBy("task").count().collect():
        chunks[row["task"]] = -(-row["count"] // chunk_rows)
    of_task = F.element_at(F.array(*map(F.lit, chunks.tolist())), (F.col("task") + 1).cast("int"))
    in_chunk = members.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_task))
    to_chunks = readers.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), (of_task - 1).cast("bigint"))))

    def nearest(chunk: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(chunk) and len(asking):
            if "list" in chunk:
                chunk = chunk.sort_values("list", kind="stable")
            ids, points = chunk["vec_id"].to_numpy(), as_matrix(chunk["vector"], width)
            lists = asking["lists"] if "lists" in asking else [None] * len(asking)
            for query_id, query, of in zip(asking["vec_id"].to_list(), as_matrix(asking["vector"], width), lists):
                chosen = np.nonzero(ids != query_id)[0]
                if of is not None:
                    in_list = np.isin(chunk["list"].to_numpy()[chosen], of)
                    chosen = chosen[in_list]
                    # A vector of two of the lists counts once.
                    chosen = chosen[np.unique(ids[chosen], return_index=True)[1]]
                distance = np.sqrt(((points[chosen] - query) ** 2).sum(axis=1))
                if len(chosen) > k:
                    near = distance <= np.partition(distance, k - 1)[k - 1]
                    chosen, distance = chosen[near], distance[near]
                order = np.lexsort((ids[chosen], distance))[:k]
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[chosen[order]], "score": distance[order]}))
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.concat(found)

    out = "query_id bigint, vec_id bigint, score double"
    found = in_chunk.groupBy("task", "chunk").cogroup(to_chunks.groupBy("task", "chunk")).applyInPandas(nearest, out)
    result = checkpointed(_ranked(found, k))

    few = result.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = checkpointed(queries.join(few, F.col("vec_id") == F.col("query_id"), "left_anti"))
    asking = short.count()
    if not asking:
        return result
    parts = -(-n // chunk_rows)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    everyone = short.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    again = rows.withColumn("part", part).groupBy("part").cogroup(everyone.groupBy("part")).applyInPandas(nearest, out)
    whole = result.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return whole.unionByName(_ranked(again, k))


def _matrix_of(df: DataFrame, width: int) -> np.ndarray:
    """The vectors of a table of bounded size, as rows."""
    vectors = df.select("vector").toArrow().column("vector").combine_chunks()
    flat = vectors.flatten().to_numpy()
    if len(flat) == width * len(vectors):
        return flat.reshape(-1, width)
    return as_matrix(pd.Series([v.values.to_numpy() for v in vectors]), width)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each query, a vector from several lists once."""
    once = found.dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
