"""Exact top-k search by inner product with MaxScore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed
from frostgrid.llm.vectors import as_matrix, whole_vectors

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
STEP_TERMS = 8
LEAST, MOST = -(2**63), 2**63 - 1


class Postings:
    """The postings of a shard, term by term: each dimension is a term with a signed impact for every vector."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.by_term = ids[order], np.ascontiguousarray(impacts[order].T)
        self.highest = self.by_term.max(axis=1, initial=0)
        self.lowest = self.by_term.min(axis=1, initial=0)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best, ties to smaller ids, without the vector ``own``."""
        terms, n = self.by_term, len(self.ids)
        bound = np.maximum(query * self.highest, query * self.lowest)
        order = np.argsort(-bound, kind="stable")
        # What all terms from a place on can add at most.
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)

        score = np.zeros(n, terms.dtype)
        candidate = np.ones(n, bool)
        at = np.searchsorted(self.ids, own)
        if at < n and self.ids[at] == own:
            candidate[at] = False
        alive = np.nonzero(candidate)[0]
        if not len(alive) or not len(order):
            return self.ids[alive[:k]], score[alive[:k]]

        # A threshold, from whole scores of those that lead after the strongest terms.
        done = min(STEP_TERMS, len(order))
        score = query[order[:done]] @ terms[order[:done]]
        threshold = None
        if len(alive) > k:
            leading = alive[np.argpartition(-score[alive], k - 1)[:k]]
            threshold = (query @ terms[:, leading]).min()
        # Essential terms, without which no vector can reach it, are traversed.
        essential = len(order) if threshold is None else max(int(np.argmax(rest < threshold)), done)
        if threshold is not None and not (rest < threshold).any():
            essential = len(order)
        score = score + query[order[done:essential]] @ terms[order[done:essential]]
        score = score[alive]
        # The others are probed, for as long as a vector stays in the race.
        while True:
            if threshold is not None:
                race = score + rest[essential] >= threshold
                alive, score = alive[race], score[race]
            if essential == len(order):
                break
            probed = order[essential:essential + STEP_TERMS]
            score = score + query[probed] @ terms[np.ix_(probed, alive)]
            essential += len(probed)
        first = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[first]], score[first]


def inner_product_top_k(
    vectors: DataFrame, is_query: Column | str, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
    vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` other vectors of highest integer inner product, for each query.

    Components count as ``floor(scale * x)``. Queries are the rows of ``vectors``
    that meet ``is_query``, a condition on ``vec_id``; candidates all other rows.
    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, ties to the
    smaller id, all candidates where they are fewer. See :func:`whole_vectors`
    for rows left out; shorter vectors count as if zeros followed, and scores
    beyond a bigint as its ends.

    Vectors are dealt into shards and queries into blocks; each pair of them is
    a task that sends at most ``k`` rows per query, which are then merged.
    """
    floors = F.transform("vector", lambda x: F.floor(F.lit(scale) * x))
    rows = checkpointed(whole_vectors(vectors, id_col, vector_col).select("vec_id", floors.alias("vector")))
    queries = rows.where(is_query)
    n, width, largest = rows.agg(
        F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))
    ).collect()[0]
    width = width or 0
    shards, blocks = max(-(-n // shard_rows), 1), max(-(-queries.count() // block_queries), 1)
    # Doubles hold sums of products exactly up to 2 ** 53.
    dtype = np.float64 if width * float(largest or 0) ** 2 < 2**53 else object

    def matrix(column: pd.Series) -> np.ndarray:
        if dtype is object:
            return as_matrix(column.map(lambda v: np.array([int(x) for x in v], object)), width, object)
        return as_matrix(column, width)

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(shard) and len(block):
            postings = Postings(shard["vec_id"].to_numpy(), matrix(shard["vector"]))
            for query_id, query in zip(block["vec_id"].to_list(), matrix(block["vector"])):
                ids, scores = postings.best(query, query_id, k)
                found += [(query_id, i, min(max(int(s), LEAST), MOST)) for i, s in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        numbered = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("shard", "block")

    pairs = dealt(rows, "shard", shards, "block", blocks).cogroup(dealt(queries, "block", blocks, "shard", shards))
    found = pairs.applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
