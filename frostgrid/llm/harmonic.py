"""Harmonic packing: lengths in reciprocal-capacity classes, a fixed number of pieces in each bin of a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.byte_tokens import byte_encoder

# A bin may stay empty to this part of its capacity before a remainder is cut again.
SLACK = 64
BATCH_TOKENS = 1 << 20
PLACED = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

# A piece: its document, its place there, its ids, and how many ids the document has.
Piece = tuple[int | None, int, np.ndarray, int]


def harmonic_cuts(tokens: int, seq_len: int, slack: int) -> list[int]:
    """The lengths into which a document of ``tokens`` ids is cut.

    Whole sequences first. What is left, ``r``, belongs to class ``k``, the
    number of times it fits in a sequence: there ``k`` pieces fill a bin. It
    stays whole if such a bin pads ``slack`` ids at most. Otherwise it gives the
    bins of class ``k + 1`` a piece that fills them, and its rest, less than a
    ``k``-th of it, is looked at in the same way.
    """
    cuts = [seq_len] * (tokens // seq_len)
    r = tokens % seq_len
    while r:
        k = seq_len // r
        cut = r if seq_len - k * r <= slack else seq_len // (k + 1)
        cuts.append(cut)
        r -= cut
    return cuts


class HarmonicBins:
    """The open bin of each class; a bin is closed as soon as it has its number of pieces.

    Less than one sequence of each class is held, whatever is put in.
    """

    def __init__(self, seq_len: int):
        self.seq_len = seq_len
        self.open: dict[int, list[Piece]] = {}

    def put(self, piece: Piece) -> list[Piece] | None:
        """Add a piece to the bin of its class; the bin, if that fills it."""
        k = self.seq_len // len(piece[2])
        members = self.open.setdefault(k, [])
        members.append(piece)
        return self.open.pop(k) if len(members) == k else None

    def rest(self) -> Iterator[list[Piece]]:
        """What no class could fill, longest first, cut so that it fills sequences.

        The last of these would be padded: its ids are cut into sequences as
        long as the powers of two that they add up to, which are not padded.
        """
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(ids) for _, _, ids, _ in left)
        whole, last = divmod(total, self.seq_len)
        sizes = [self.seq_len] * whole + [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1]
        pieces = iter(left)
        piece = None
        for size in sizes:
            members: list[Piece] = []
            while size:
                doc_id, start, ids, of_doc = piece or next(pieces)
                members.append((doc_id, start, ids[:size], of_doc))
                piece = (doc_id, start + size, ids[size:], of_doc) if len(ids) > size else None
                size -= len(members[-1][2])
            yield members


def harmonic_sequences(
    docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, slack: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Documents as token ids with ``end_id`` after them, packed in sequences of at most ``seq_len``.

    ``tokenizer`` is the content of a tokenizer file. One row per piece:
    ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids``
    (little-endian unsigned 32-bit numbers), ``doc_tokens`` (the ids of its
    document with ``end_id``), ``sequence_id`` and ``offset``, the piece's place in
    the sequence. A null or empty text is ``end_id`` alone; repeated rows and
    rows without an id are all packed; other columns are not looked at.

    Documents are cut by :func:`harmonic_cuts` (``slack``: a 64th of ``seq_len``
    if not given) and dealt to the bins of their classes. Each task fills bins
    of its own with what it reads, so nothing is shuffled and a task holds less
    than one sequence per class. What is left in open bins at its end is cut
    once more and padded nowhere. ``sequence_id`` has the task's number above
    bit 40, so a task that is run again gives the same numbers.
    """
    slack = seq_len // SLACK if slack is None else slack
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in PLACED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = byte_encoder(tokenizer), HarmonicBins(seq_len)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0

        def place(members: list[Piece]) -> int:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, of_doc in members:
                rows.append((doc_id, start, len(ids), ids.tobytes(), of_doc, sequence, offset))
                offset += len(ids)
            sequence += 1
            return offset

        def as_batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, encoded in zip(batch.column(0).to_pylist(), words.encode_all(texts)):
                data = np.append(encoded, np.uint32(end_id)).astype("<u4")
                start = 0
                for cut in harmonic_cuts(len(data), seq_len, slack):
                    # A copy, so that a piece that waits does not hold its whole document.
                    full = bins.put((doc_id, start, data[start:start + cut].copy(), len(data)))
                    if full:
                        held += place(full)
                    start += cut
                if held >= BATCH_TOKENS:
                    yield as_batch()
                    held = 0
        for members in bins.rest():
            place(members)
        yield as_batch()

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pack, PLACED)
