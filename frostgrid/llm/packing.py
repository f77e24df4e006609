"""Packing tokenized documents into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed
from frostgrid.llm.tokens import encoder

SHARD_PIECES = 32768
BUFFER_TOKENS = 8_000_000


def token_pieces(
    docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents as token ids with ``end_id`` after them, cut where longer than ``seq_len``.

    ``tokenizer`` is the content of a tokenizer file. One row per piece:
    ``doc_id``, ``piece`` (from 0), ``start``, ``length`` and ``ids_crc32``, the
    checksum of the ids as little-endian unsigned 32-bit numbers. A null or
    empty text has one piece, of ``end_id`` alone. The ids themselves are not kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, encoded in zip(batch.column(0).to_pylist(), words.encode_all(texts)):
                data = np.append(encoded, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(data), seq_len)):
                    ids = data[start:start + seq_len]
                    row = (doc_id, piece, start, len(ids), zlib.crc32(ids.tobytes()))
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """A sequence (from 0) and an offset in it for each length, none above ``seq_len``.

    ``open_bins[g]`` counts the open sequences with ``g`` tokens left. A length
    ``s`` goes where the sum of the squared counts becomes smallest: moving a
    sequence from gap ``g`` to ``g - s`` changes it by twice
    ``open_bins[g - s] - open_bins[g] + 1``; a sequence that becomes full leaves
    the sum. Longest first; a new sequence is opened only where none has room.
    """
    open_bins = np.zeros(seq_len + 1, np.int64)
    with_gap: list[list[int]] = [[] for _ in range(seq_len + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    none = np.iinfo(np.int64).max
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        here = open_bins[s:]
        change = np.where(here > 0, open_bins[:len(here)] - here, none)
        if here[0]:
            change[0] = -here[0]
        best = int(change.argmin())
        if change[best] == none:
            gap, number = seq_len, used
            used += 1
        else:
            gap = s + best
            number = with_gap[gap].pop()
            open_bins[gap] -= 1
        sequence[i], offset[i] = number, seq_len - gap
        if gap > s:
            with_gap[gap - s].append(number)
            open_bins[gap - s] += 1
    return sequence, offset


def pack_sequences(pieces: DataFrame, seq_len: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place every piece in a sequence: adds ``sequence_id`` and ``offset``.

    ``pieces`` are those of :func:`token_pieces`, with ``length`` from 1 to
    ``seq_len``. They are dealt by hash into shards of about ``shard_pieces`` that are
    packed on their own, at a cost of a part of a sequence each.
    ``sequence_id`` has the shard above bit 32. Repeated rows are all placed.
    """
    kept = checkpointed(pieces)
    shards = max(-(-kept.count() // shard_pieces), 1)

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], kind="stable")
        number, offset = sum_of_squares(shard["length"].to_numpy(), seq_len)
        shard["sequence_id"] = (shard["shard"].to_numpy() << 32) + number
        shard["offset"] = offset
        return shard.drop(columns="shard")

    by_hash = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return kept.withColumn("shard", by_hash).groupBy("shard").applyInPandas(pack, schema)


class CapacityTree:
    """A segment tree over the capacities that open bins have left.

    Each leaf is a capacity with the bins that have it, each inner node knows
    whether a bin is below. The best fit for a length is the first leaf from
    there on that is not empty, found by going up and down once.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.below = [0] * (2 * self.size)

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        node = self.size + capacity
        while node:
            self.below[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the tightest bin with room, if there is one."""
        below, node = self.below, self.size + length
        while not below[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not below[2 * node])
        capacity = node - self.size
        while node:
            below[node] -= 1
            node >>= 1
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, seq_len: int) -> list[list[int]]:
    """The indexes of the lengths in each bin, in the order of placing."""
    tree, bins = CapacityTree(seq_len), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found = seq_len, len(bins)
            bins.append([])
        capacity, number = found
        bins[number].append(i)
        if capacity > length:
            tree.add(capacity - length, number)
    return bins


PACKED = (
    "doc_ids array<bigint>, pieces array<int>, n_tokens int, input_ids binary, "
    "cu_seqlens array<int>, position_ids binary, id_bytes int"
)


def packed_matrices(
    docs: DataFrame,
    tokenizer: str,
    vocabulary: int,
    seq_len: int = 2048,
    end_id: int = 0,
    pad_id: int = 0,
    buffer_tokens: int = BUFFER_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents as rows of id matrices, packed best fit decreasing.

    Every row is one sequence: ``input_ids`` and ``position_ids`` are ``seq_len``
    little-endian unsigned numbers of ``id_bytes`` bytes (2 where ``vocabulary``
    and ``seq_len`` allow, else 4), ``cu_seqlens`` the offsets at which segments
    begin and the last ends. Positions start at 0 in every segment; after
    ``n_tokens`` there is ``pad_id`` at position 0. Segment ``i`` is piece
    ``pieces[i]`` of document ``doc_ids[i]``; a longer document is cut every ``seq_len``
    tokens, so its pieces in order are its ids and ``end_id``. A null or empty
    text is ``end_id`` alone; repeated rows are all packed.

    Nothing is shuffled: each task packs what it reads, ``buffer_tokens`` at a time.
    Stacked rows are the matrix; write them with any file format of Spark.
    """
    wide = max(vocabulary, seq_len) > 1 << 16
    kind = "<u4" if wide else "<u2"

    def rows_of(held: list[tuple]) -> Iterator[tuple]:
        lengths = np.fromiter((len(ids) for _, _, ids in held), np.int64, len(held))
        for members in best_fit_decreasing(lengths, seq_len):
            ends = np.cumsum(lengths[members])
            ids = np.full(seq_len, pad_id, kind)
            ids[:ends[-1]] = np.concatenate([held[i][2] for i in members])
            positions = np.zeros(seq_len, kind)
            positions[:ends[-1]] = np.concatenate([np.arange(lengths[i]) for i in members])
            yield (
                [held[i][0] for i in members], [held[i][1] for i in members], int(ends[-1]), ids.tobytes(),
                [0, *ends.tolist()], positions.tobytes(), ids.itemsize,
            )

    types = [
        pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.int32()
    ]
    names = [part.split()[0] for part in PACKED.split(", ")]

    def as_batches(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(rows_of(held))
        for at in range(0, len(rows), 512):
            columns = zip(*rows[at:at + 512])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        held, tokens = [], 0
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, encoded in zip(batch.column(0).to_pylist(), words.encode_all(texts)):
                data = np.append(encoded, np.uint32(end_id)).astype(kind)
                for piece, start in enumerate(range(0, len(data), seq_len)):
                    held.append((doc_id, piece, data[start:start + seq_len]))
                tokens += len(data)
                if tokens >= buffer_tokens:
                    yield from as_batches(held)
                    held, tokens = [], 0
        yield from as_batches(held)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pack, PACKED)
