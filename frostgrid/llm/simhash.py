"""Near-duplicate documents by SimHash fingerprints and vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, join_classes, join_lookup
from frostgrid.llm.components import components

SEED = 42
# Fingerprints that a tree is fitted to, for each of its leaves.
LEAF_SAMPLE = 16
SAMPLE_ROWS = 4096
# Points of a shard, of a task where a shard is larger, and of a leaf inside a task.
LEAF_ROWS = 32768
CHUNK_ROWS = 131072
INNER_ROWS = 128
# Queries that walk the tree of a task at once; each reaches some dozens of its leaves.
SEARCH_ROWS = 8192
MOST_LEVELS = 16
BITS = 64


def fingerprint(text: bytes | None, words_per_shingle: int = 4) -> int:
    """SimHash of the shingles of a text, 0 when it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(len(words) - words_per_shingle + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(ends) - n:].tolist())
    return majority(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where more than half of the hashes have them set, 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: ``doc_id`` and its 64-bit ``fp``, as a signed bigint.

    Words are what white space of ASCII parts, with A-Z in lower case. A text of
    fewer words than a shingle counts as one shingle; a null text, or one without
    words, has the fingerprint zero.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(of_batches, "doc_id bigint, fp bigint")


class VantageTree:
    """The upper levels of a vantage-point tree, fitted to a sample.

    Each level looks at its own part of the 64 bits. A node holds a vantage
    point and a radius: points whose distance from it, on the part of the
    level, is within the radius go left, others right. By the triangle bound a
    ball that lies on one side reaches the other only if it is at least as wide
    as its centre is far from the radius. The parts of the levels are disjoint,
    so these costs add up along a path, and a branch is pruned as soon as their
    sum exceeds the reach of the search.
    """

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        cuts = [BITS * j // max(levels, 1) for j in range(levels + 1)]
        full = (1 << BITS) - 1
        self.masks = [np.uint64(((full << a) & full) & (full >> (BITS - b))) for a, b in zip(cuts, cuts[1:])]
        self.vantage = np.zeros(2**levels, np.uint64)
        self.radius = np.zeros(2**levels, np.int64)
        self._fit(sample, 0, 0)

    def _fit(self, sample: np.ndarray, node: int, level: int) -> None:
        if level == self.levels:
            return
        mask = self.masks[level]
        best = None
        for vantage in sample[:16] if len(sample) else np.zeros(1, np.uint64):
            d = np.bitwise_count((sample ^ vantage) & mask).astype(np.int64)
            radius = int(np.median(d)) if len(d) else (int(mask).bit_count() - 1) // 2
            for r in (radius - 1, radius):
                # Even halves, and few points next to the border.
                left = (d <= r).mean() if len(d) else 0.5
                score = abs(left - 0.5) + 0.25 * (np.abs(d - r - 0.5) < 1).mean() if len(d) else 0.0
                if r >= 0 and (best is None or score < best[0]):
                    best = (score, vantage, r, d)
        if best is None:
            best = (0.0, np.uint64(0), 0, np.bitwise_count(sample & mask).astype(np.int64))
        _, self.vantage[node], self.radius[node], d = best
        self._fit(sample[d <= best[2]], 2 * node + 1, level + 1)
        self._fit(sample[d > best[2]], 2 * node + 2, level + 1)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        for mask in self.masks:
            right = np.bitwise_count((points ^ self.vantage[node]) & mask) > self.radius[node]
            node = 2 * node + 1 + right
        return node

    def reached(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """All (index of a point, leaf) whose leaf may hold something within ``reach`` of the point."""
        index, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        spent = np.zeros(len(points), np.int64)
        for mask in self.masks:
            d = np.bitwise_count((points[index] ^ self.vantage[node]) & mask).astype(np.int64) - self.radius[node]
            right = d > 0
            cost = spent + np.where(right, d, 1 - d)
            over = cost <= reach
            own = 2 * node + 1 + right
            other = 2 * node + 2 - right
            index = np.concatenate([index, index[over]])
            node = np.concatenate([own, other[over]])
            spent = np.concatenate([spent, cost[over]])
        return index, node


def stars_in_leaf(homes: np.ndarray, queries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that lies within ``reach``, a query and a home at a time.

    Both arrays hold distinct points. A tree over the points at home prunes the
    search in memory; each class found is returned as a star.
    """
    points = np.unique(np.concatenate([homes, queries]))
    root = np.arange(len(points))
    if len(homes) and len(queries):
        tree = VantageTree(homes[:: len(homes) // SAMPLE_ROWS + 1], _levels(len(homes), INNER_ROWS))
        home = tree.home(homes)
        order = np.argsort(home)
        homes, home = homes[order], home[order]
        at_h, at_q = np.searchsorted(points, homes), np.searchsorted(points, queries)
        for part in range(0, len(queries), SEARCH_ROWS):
            index, leaf = tree.reached(queries[part:part + SEARCH_ROWS], reach)
            order = np.argsort(leaf)
            index, leaf = index[order] + part, leaf[order]
            for one in np.unique(home):
                h0, h1 = np.searchsorted(home, [one, one + 1])
                q0, q1 = np.searchsorted(leaf, [one, one + 1])
                for b in range(h0, h1, 1024):
                    near = homes[b:min(b + 1024, h1)]
                    for a in range(q0, q1, 128):
                        of = index[a:min(a + 128, q1)]
                        i, k = np.nonzero(np.bitwise_count(queries[of, None] ^ near[None, :]) <= reach)
                        if len(i):
                            _unite(root, at_q[of[i]], at_h[b + k])
    linked = np.nonzero(root != np.arange(len(points)))[0]
    return points[linked], points[root[linked]]


def _levels(rows: int, leaf_rows: int) -> int:
    return min(max(math.ceil(math.log2(max(rows, 1) / leaf_rows)), 0), MOST_LEVELS)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def near_links(points: DataFrame, reach: int = 4, leaf_rows: int = LEAF_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints, with the same components as all pairs within ``reach``.

    ``points`` has one column, ``fp``, without repeats; an empty table gives no
    rows. A vantage-point tree is fitted to a sample of about ``LEAF_SAMPLE``
    fingerprints for each of its leaves, of which there are at most ``2 ** MOST_LEVELS``,
    and ``SAMPLE_ROWS`` at least. A point is sent to its own leaf and, as a query only, to each
    leaf of higher number that its ball reaches; every pair within reach meets
    in the leaf of one of the two. A leaf of more than ``chunk_rows`` points has its
    queries dealt over several tasks that each hold all points at home there.
    """
    spark = points.sparkSession
    rows = points.count()
    levels = _levels(rows, leaf_rows)
    wanted = max(SAMPLE_ROWS, LEAF_SAMPLE << levels)
    share = min(wanted / max(rows, 1), 1.0)
    drawn = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = [r.fp for r in drawn.orderBy(F.xxhash64("fp"), "fp").collect()]
    tree = VantageTree(np.array(sample, np.int64).view(np.uint64), levels)

    def with_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"leaf": tree.home(batch["fp"].to_numpy().view(np.uint64))})

    # One number per leaf, of which there are at most 2 ** MOST_LEVELS.
    sizes = points.mapInPandas(with_home, "leaf bigint").groupBy("leaf").count().collect()
    chunks = np.ones(2 ** (levels + 1), np.int64)
    for row in sizes:
        chunks[row["leaf"]] = -(-row["count"] // chunk_rows)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 16384):
                fp = batch["fp"].to_numpy()[at:at + 16384]
                u = fp.view(np.uint64)
                home = tree.home(u)
                index, leaf = tree.reached(u, reach)
                keep = leaf >= home[index]
                index, leaf = index[keep], leaf[keep]
                salt = ((u[index] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                chunk = salt % chunks[leaf]
                at_home = leaf == home[index]
                out = [pd.DataFrame({"leaf": leaf, "chunk": chunk, "fp": fp[index], "home": at_home, "query": True})]
                for extra in range(1, int(chunks[home].max(initial=1))):
                    more = np.nonzero(chunks[home] > extra)[0]
                    own = index[at_home].argsort()
                    other = (chunk[at_home][own][more] + extra) % chunks[home[more]]
                    out.append(
                        pd.DataFrame(
                            {"leaf": home[more], "chunk": other, "fp": fp[more], "home": True, "query": False}
                        )
                    )
                yield pd.concat(out)

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        a, b = stars_in_leaf(fp[group["home"].to_numpy()], fp[group["query"].to_numpy()], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = points.mapInPandas(dealt, "leaf bigint, chunk bigint, fp bigint, home boolean, query boolean")
    return placed.groupBy("leaf", "chunk").applyInPandas(linked, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, reach: int = 4, **limits: int
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``.

    Fingerprints that differ in at most ``reach`` bits are linked, equal ones
    among them; ``component_id`` is the smallest ``doc_id`` that links lead to.
    Ids that are null never become a component's id. Repeated rows stay.
    Copies share a fingerprint and are looked at once.
    """
    of_docs = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    found = components(near_links(classes.select("fp"), reach, **limits))
    placed = found.join(classes.select(F.col("fp").alias("node"), "first_id"), "node")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("smallest"))
    moved = join_lookup(placed, smallest, "root", F.col("node")).select(F.col("node").alias("fp"), "smallest")
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("smallest", "first_id").alias("component_id"), "n")
    # A group of copies may hold a third of all rows.
    return join_classes(of_docs, ids, "fp", F.col("doc_id"), "inner").select("doc_id", "fp", "component_id")
