"""Removal of byte strings that occur in earlier documents, by parsing and suffix sorting.

A rolling hash over ``GRAM`` bytes sets the triggers: the smallest hash in a
window of ``length`` bytes is one, so every window holds a trigger, and the
same window always the same one. A phrase is the text of all neighbouring
windows that share a trigger. Distinct phrases are the dictionary, their order
in the documents the parse. Documents are parsed in buckets; what buckets have
to tell each other goes by shards of the trigger:

1. Each bucket sends the hashes of its triggers. A shard answers with those
   found in more than one document; all others begin no repeat.
2. Each bucket sends its dictionary of phrases at such triggers. A shard merges
   dictionaries, sorts the suffixes of ``length`` bytes or more, and finds the first
   document of every run that agrees in so many.
3. Back in its bucket, the parse carries these to all places of a phrase, which
   are thereby in corpus order: a window goes if its first document is smaller.

Copies cost little: a bucket names a phrase once, however often it occurs. A
trigger with very many phrases around it (the border of a passage that a third
of all documents share) is cut up further: there each window is sent on its
own, to the shard of its content, so a shard gets it at most once per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import give_back, tasks

GRAM = 24
BUCKET_BYTES = 4_000_000
TASK_BYTES = 64_000_000
CROWDED = 20_000
CHUNK = 1 << 15
# Triggers are told apart by 48 bits; a mistake costs some work and changes nothing.
SHORT = np.uint64(16)
NO_ID = np.iinfo(np.int64).max

_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(51).integers(0, 2**64, 16, dtype=np.uint64).tolist()]


def _joined(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """A hash of two hashes, the order of which counts."""
    out = left * _ODD[k] + right
    out ^= out >> np.uint64(29)
    out *= _ODD[k + 8]
    out ^= out >> np.uint64(32)
    return out


def rolling_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes from each position on, by doubling."""
    power, total, width, level = _BYTES[data], None, 0, 0
    while gram >> level:
        size = 1 << level
        if gram & size:
            if total is None:
                total, width = power, size
            else:
                tail = power[width:]
                total = _joined(total[:len(tail)], tail, level)
                width += size
        if gram >> (level + 1):
            power = _joined(power[:len(power) - size], power[size:], level)
        level += 1
    return total


class Phrases:
    """The parse of a bucket: one entry for each phrase where it stands."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("__id").combine_chunks()
        self.ids = np.where(ids.is_null().to_numpy(zero_copy_only=False), NO_ID, ids.fill_null(0).to_numpy())
        text = table.column("__text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
        raw = text.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data, self.ends = whole[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]
        self.begins = offsets[:-1] - offsets[0]
        self.length = length
        self._parse()

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of some ``CHUNK`` bytes that hold whole documents, or a part of one that is longer.

        Where a phrase is cut depends on its document alone. The rows of a bucket come in
        another order each time they are read, and each reading must find the same phrases.
        """
        at = 0
        for begin, end in zip(self.begins.tolist(), self.ends.tolist()):
            if end - at > CHUNK:
                if begin > at:
                    yield at, begin
                at = begin
            while end - at > CHUNK:
                yield at, at + CHUNK
                at += CHUNK
            # What is left of a document that was cut stands alone.
            if at > begin:
                yield at, end
                at = end
        if len(self.data) > at:
            yield at, len(self.data)

    def _parse(self) -> None:
        n, length = len(self.data), self.length
        valid = np.ones(n, bool)
        for begin, end in zip(self.begins.tolist(), self.ends.tolist()):
            valid[max(end - length + 1, begin):end] = False
        span = length - GRAM + 1
        parts: list[tuple[np.ndarray, ...]] = []
        for at, end in self._chunks():
            if min(end + length - 1, n) - at < length:
                continue
            hashes = rolling_hash(self.data[at:end + length - 1], GRAM)
            low = np.uint64((1 << 16) - 1)
            least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
            width = 1
            while width < span:
                step = min(width, span - width)
                least = np.minimum(least[:len(least) - step], least[step:])
                width += step
            trigger = (least & low).astype(np.int64)
            good = valid[at:at + len(trigger)]
            change = np.ones(len(trigger), bool)
            change[1:] = (trigger[1:] != trigger[:-1]) | ~good[:-1]
            first = np.nonzero(change & good)[0]
            # A phrase ends before the next one begins, or where its document has no more windows.
            stop = np.ones(len(trigger), bool)
            stop[:-1] = (trigger[1:] != trigger[:-1]) | ~good[1:]
            last = np.nonzero(stop & good)[0]
            tail = last + length - GRAM
            key = hashes[first] * _ODD[1]
            # A phrase has less than two lengths; these grams and the last cover it.
            for k, step in enumerate(range(GRAM, 2 * length - 2 * GRAM, GRAM)):
                key = _joined(key, hashes[np.minimum(first + step, tail)], k % 8)
            key = _joined(key, hashes[tail], 2) ^ (last - first).astype(np.uint64)
            # The least of many hashes is small, so it is spread over all numbers again.
            spread = hashes[trigger[first]] * _ODD[4]
            spread = (spread ^ (spread >> np.uint64(32))) * _ODD[5]
            parts.append((first + at, last + at, spread, key))
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.first, self.last, self.trigger, self.key = (np.concatenate(c) for c in zip(*(parts or [empty])))
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        # The trigger of the phrase that a window was cut from.
        self.origin = self.trigger

    def windows(self, crowded: np.ndarray) -> Phrases:
        """Cut the phrases marked in ``crowded`` into one phrase for each window."""
        if not crowded.any():
            return self
        cut = Phrases.__new__(Phrases)
        cut.__dict__.update(self.__dict__)
        counts = (self.last - self.first + 1)[crowded]
        ends = np.cumsum(counts)
        start = np.repeat(self.first[crowded] - ends + counts, counts) + np.arange(ends[-1])
        # The content alone decides key and shard.
        words = [_words(self.data, start, self.length, k) for k in range(-(-self.length // 8))]
        key = words[0] * _ODD[3]
        for k, word in enumerate(words[1:]):
            key = _joined(key, word, k % 8)
        whole = ~crowded
        cut.first = np.concatenate([self.first[whole], start])
        cut.last = np.concatenate([self.last[whole], start])
        cut.trigger = np.concatenate([self.trigger[whole], key])
        cut.key = np.concatenate([self.key[whole], key])
        cut.origin = np.concatenate([self.trigger[whole], np.repeat(self.trigger[crowded], counts)])
        cut.doc = np.concatenate([self.doc[whole], np.repeat(self.doc[crowded], counts)])
        return cut


def _words(data: np.ndarray, start: np.ndarray, length: int, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of the windows at ``start``, the last eight at most, as numbers in their order."""
    at = start + min(8 * k, length - 8)
    word = np.zeros(len(start), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | data[at + i]
    return word


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _shard(trigger: np.ndarray, shards: int) -> np.ndarray:
    return ((trigger >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)


def _packed(array: np.ndarray) -> bytes:
    """An array compressed byte by byte: first the first bytes of all numbers, then the second ones."""
    raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    if not any(blob[:8]):
        return np.zeros(0, kind)
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _blobs(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [_unpacked(x, kind) for x in table.column(name).to_pylist()]


TRIGGERS = pa.schema([("shard", pa.int64()), ("bucket", pa.int64()), ("triggers", pa.binary()), ("seen", pa.binary())])
REPEATED = pa.schema([("bucket", pa.int64()), ("triggers", pa.binary()), ("crowded", pa.binary())])
DICTIONARY = pa.schema([
    ("shard", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()),
    ("text", pa.binary()), ("origins", pa.binary()),
])
FOUND = pa.schema([
    ("bucket", pa.int64()), ("keys", pa.binary()), ("runs", pa.binary()), ("windows", pa.binary()), ("ids", pa.binary()),
    ("cut", pa.binary()), ("origins", pa.binary()),
])


def triggers_of(phrases: Phrases, bucket: int, shards: int) -> pa.Table:
    """The triggers of a bucket, with the number of phrases at each (127 at most) and a bit for two documents."""
    order = np.lexsort((phrases.key, phrases.trigger))
    trigger, key, doc = phrases.trigger[order], phrases.key[order], phrases.ids[phrases.doc[order]]
    if not len(trigger):
        return _rows(TRIGGERS, [])
    new = np.ones(len(trigger), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    at = np.nonzero(new)[0]
    other = new.copy()
    other[1:] |= key[1:] != key[:-1]
    seen = np.minimum(np.add.reduceat(other.astype(np.int64), at), 127)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    trigger, seen = trigger[at], (seen + 128 * several).astype(np.uint8)
    bounds = np.searchsorted(_shard(trigger, shards), np.arange(shards + 1))
    return _rows(TRIGGERS, [
        (s, bucket, _packed(trigger[a:b] >> SHORT), _packed(seen[a:b]))
        for s, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if a < b
    ])


def repeated_triggers(table: pa.Table, crowded: int) -> pa.Table:
    """For each bucket, which of the triggers it sent are in two documents, and which are crowded."""
    sent = _blobs(table, "triggers", "<u8")
    of = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    trigger, seen = np.concatenate(sent), np.concatenate(_blobs(table, "seen", "u1")).astype(np.int64)
    order = np.argsort(trigger, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = trigger[order][1:] != trigger[order][:-1]
    at = np.nonzero(new)[0]
    sizes = np.diff(np.append(at, len(order)))
    several = (sizes > 1) | (np.maximum.reduceat(seen[order], at) >= 128)
    many = np.add.reduceat(seen[order] % 128, at) > crowded
    keep, much = np.zeros(len(order), bool), np.zeros(len(order), bool)
    keep[order], much[order] = np.repeat(several, sizes), np.repeat(many, sizes)
    rows = []
    for i, bucket in enumerate(table.column("bucket").to_pylist()):
        a, b = np.searchsorted(of, [i, i + 1])
        chosen = keep[a:b]
        if chosen.any():
            rows.append((bucket, _packed(trigger[a:b][chosen]), _packed(much[a:b][chosen].astype(np.uint8))))
    return _rows(REPEATED, rows)


def _lookup(wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` stands in the sorted ``known``, and whether it does."""
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return at, (known[at] == wanted) if len(known) else np.zeros(len(wanted), bool)


def dictionary_of(phrases: Phrases, bucket: int, shards: int, repeated: pa.Table) -> pa.Table:
    """The distinct phrases of a bucket at repeated triggers, each with its smallest document."""
    known = np.concatenate([np.zeros(0, np.uint64), *_blobs(repeated, "triggers", "<u8")])
    much = np.concatenate([np.zeros(0, np.uint8), *_blobs(repeated, "crowded", "u1")])
    order = np.argsort(known)
    known, much = known[order], much[order].astype(bool)
    at, hit = _lookup(phrases.trigger >> SHORT, known)
    kept = Phrases.__new__(Phrases)
    kept.__dict__.update(phrases.__dict__)
    for name in ("first", "last", "trigger", "key", "doc", "origin"):
        setattr(kept, name, getattr(phrases, name)[hit])
    single = much[at[hit]] if len(much) else np.zeros(0, bool)
    cut = kept.windows(single)
    if not len(cut.key):
        return _rows(DICTIONARY, [])
    is_cut = np.arange(len(cut.key)) >= len(cut.key) - int((kept.last - kept.first + 1)[single].sum())
    shard = _shard(cut.trigger, shards)
    order = np.lexsort((cut.key, shard))
    key, shard = cut.key[order], shard[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    at = np.nonzero(new)[0]
    first_id = np.minimum.reduceat(cut.ids[cut.doc[order]], at)
    chosen = order[at]
    size = cut.last[chosen] - cut.first[chosen] + cut.length
    # The top bit of a size tells windows that were cut off from phrases.
    sizes = (size | (is_cut[chosen].astype(np.int64) << 15)).astype("<u2")
    bounds = np.searchsorted(shard[at], np.arange(shards + 1))
    return _rows(DICTIONARY, [
        (
            s, bucket, _packed(key[at[a:b]]), _packed(first_id[a:b]), _packed(sizes[a:b]),
            _packed(_gathered(cut.data, cut.first[chosen[a:b]], size[a:b])),
            _packed(np.unique(cut.origin[chosen[a:b]][is_cut[chosen[a:b]]])),
        )
        for s, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if a < b
    ])


def _words_at(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each of the positions on, as numbers in their order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    # A view of all positions, which takes no memory; phrases have several bytes for each suffix.
    every = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,), writeable=False)
    return every[start].byteswap(inplace=True)


def suffix_array(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start`` in the order of their first ``length`` bytes, and which of them differ from the one before.

    Sorted by the first eight bytes, then word by word inside the classes that
    are still equal. A class is sorted again only if its next words differ, so
    copies, which are most of what a dictionary shares, cost a comparison.
    """
    first = _words_at(data, start)
    order = np.argsort(first).astype(start.dtype)
    first = first[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    del first
    tied = np.arange(len(order), dtype=start.dtype)
    for depth in [*range(8, length - 8, 8), length - 8]:
        # Suffixes that are equal to a neighbour so far.
        alone = new[tied] & np.append(new[tied[1:]], True)
        tied = tied[~alone]
        if not len(tied):
            break
        here = _words_at(data, start[order[tied]] + depth)
        opens = new[tied]
        differs = np.zeros(len(tied), bool)
        differs[1:] = (here[1:] != here[:-1]) & ~opens[1:]
        of = np.cumsum(opens, dtype=start.dtype) - 1
        unsettled = np.nonzero(np.bincount(of[differs], minlength=of[-1] + 1)[of])[0]
        if len(unsettled):
            again = unsettled[np.lexsort((here[unsettled], of[unsettled]))]
            order[tied[unsettled]] = order[tied[again]]
            here[unsettled] = here[again]
            new[tied[1:]] |= here[1:] != here[:-1]
    return order, new


def first_documents(table: pa.Table, length: int) -> pa.Table:
    """For each phrase a bucket sent, the first document of each of its windows, as runs of windows."""
    keys, ids = _blobs(table, "keys", "<u8"), np.concatenate(_blobs(table, "ids", "<i8"))
    sizes = np.concatenate(_blobs(table, "sizes", "<u2")).astype(np.int64)
    cut, sizes = sizes >> 15, sizes & 0x7FFF
    data = np.concatenate(_blobs(table, "text", "u1"))
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    ends = np.cumsum(count)
    # Half the memory for positions, unless there are too many.
    place = np.int32 if len(data) < 1 << 31 else np.int64
    start = np.arange(ends[-1], dtype=place)
    start += np.repeat((begin - ends + count).astype(place), count)
    suffixes, new = suffix_array(data, start, length)
    del start
    # Documents by rank, in half the memory of their ids.
    known, rank = np.unique(ids, return_inverse=True)
    first = np.repeat(rank.astype(place), count)
    at = np.nonzero(new)[0]
    del new
    least = np.minimum.reduceat(first[suffixes], at)
    first[suffixes] = np.repeat(least, np.diff(at, append=len(suffixes)))
    del suffixes, least, at

    change = np.ones(len(first), bool)
    change[1:] = first[1:] != first[:-1]
    change[ends - count] = True
    run = np.nonzero(change)[0]
    windows = np.diff(np.append(run, len(first)))
    of = np.searchsorted(ends, run, side="right")
    rows, a, r = [], 0, 0
    runs = np.bincount(of, minlength=len(sizes))
    sent = (table.column(name).to_pylist() for name in ("bucket", "keys", "origins"))
    for bucket, packed, origins, mine in zip(*sent, keys):
        b = a + len(mine)
        n = int(runs[a:b].sum())
        rows.append((
            bucket, packed, _packed(runs[a:b].astype("<u2")), _packed(windows[r:r + n].astype("<u2")),
            _packed(known[first[run[r:r + n]]]), _packed(cut[a:b].astype(np.uint8)), origins,
        ))
        a, r = b, r + n
    return _rows(FOUND, rows)


def removed_bytes(phrases: Phrases, found: pa.Table) -> np.ndarray:
    """Which bytes of a bucket lie in a window whose first document is smaller than their own."""
    change = np.zeros(len(phrases.data) + 1, np.int32)
    joined = {n: np.concatenate([np.zeros(0, k), *_blobs(found, n, k)]) for n, k in
              (("keys", "<u8"), ("runs", "<u2"), ("windows", "<u2"), ("ids", "<i8"), ("cut", "u1"))}
    runs = joined["runs"].astype(np.int64)
    run_at = np.cumsum(runs) - runs
    is_cut = joined["cut"].astype(bool)
    for crowded in (False, True):
        mine = np.nonzero(is_cut == crowded)[0]
        if not len(mine):
            continue
        mine = mine[np.argsort(joined["keys"][mine])]
        parse = phrases
        if crowded:
            origins = np.unique(np.concatenate(_blobs(found, "origins", "<u8")))
            parse = phrases.windows(_lookup(phrases.trigger, origins)[1])
        at, hit = _lookup(parse.key, joined["keys"][mine])
        place, entry = np.nonzero(hit)[0], mine[at[hit]]
        n = runs[entry]
        ends = np.cumsum(n)
        each = np.repeat(run_at[entry] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        width = joined["windows"][each].astype(np.int64)
        whole = np.cumsum(width)
        # The offset of a run in its phrase: the windows before it, less those of earlier phrases.
        before = whole - width
        offset = before - np.repeat(before[ends - n] if len(ends) else before, n)
        start = np.repeat(parse.first[place], n) + offset
        gone = joined["ids"][each] < np.repeat(parse.ids[parse.doc[place]], n)
        np.add.at(change, start[gone], 1)
        np.add.at(change, (start + width + phrases.length - 1)[gone], -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    bucket_bytes: int = BUCKET_BYTES,
    crowded: int = CROWDED,
    as_text: bool = False,
) -> DataFrame:
    """Remove all bytes covered by a string of ``length`` bytes that starts in a document with a smaller id too.

    One row per document: ``doc_id``, ``kept`` (binary: the bytes left, joined),
    ``spans`` (the removed ranges, from ``start`` to before ``end``, apart from
    each other) and the columns in ``keep``. With ``as_text``, ``kept`` is a string and
    parts of characters left at a cut go too. Texts count as UTF-8, null as empty;
    strings do not cross documents and are judged on the input. Rows of one id
    are one document to each other and remove nothing of each other; null is
    larger than every id. ``length`` is from 32 to 2000. The method is described at the
    top of the module; phrases of a bucket are told apart by hashes of 64 bits,
    strings of different documents by their bytes.
    """
    if not 32 <= length <= 2000:
        raise ValueError("length must be from 32 to 2000")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    total = docs.agg(F.sum(F.octet_length(text_col))).collect()[0][0] or 0
    buckets = max(tasks(spark), -(-total // bucket_bytes))
    shards = buckets
    slim = docs.select(
        F.col(id_col).cast("bigint").alias("__id"), text.alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep]
    )
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("__id", "__text"), F.lit(buckets)))
    # A number of its own, since by their bytes tasks would be merged into too few for the work in them.
    parts = max(tasks(spark), -(-total // TASK_BYTES))
    dealt = dealt.repartition(parts, "bucket")

    def bucket_of(table: pa.Table) -> int:
        return table.column("bucket")[0].as_py()

    def send_triggers(table: pa.Table) -> pa.Table:
        sent = triggers_of(Phrases(table, length), bucket_of(table), shards)
        give_back()
        return sent

    def answer_triggers(table: pa.Table) -> pa.Table:
        return repeated_triggers(table, crowded)

    def send_dictionary(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not len(table) or not len(repeated):
            return _rows(DICTIONARY, [])
        sent = dictionary_of(Phrases(table, length), bucket_of(table), shards, repeated)
        give_back()
        return sent

    def answer_dictionary(table: pa.Table) -> pa.Table:
        found = first_documents(table, length)
        give_back()
        return found

    kept_fields = [f for f in slim.schema.fields if f.name.startswith("__keep_")]

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            spans, kept = [[]] * len(table), table.column("__text")
        else:
            phrases = Phrases(table, length)
            gone = removed_bytes(phrases, found)
            kept, spans = [], []
            for a, b in zip(phrases.begins.tolist(), phrases.ends.tolist()):
                mine = gone[a:b]
                if mine.any():
                    edges = np.nonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))[0].tolist()
                    spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2])])
                    kept.append(phrases.data[a:b][~mine].tobytes())
                else:
                    spans.append([])
                    kept.append(phrases.data[a:b].tobytes())
            del phrases, gone
            give_back()
        if as_text:
            texts = kept.to_pylist() if isinstance(kept, pa.ChunkedArray) else kept
            kept = pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string())
        elif not isinstance(kept, pa.ChunkedArray):
            kept = pa.array(kept, pa.binary())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [table.column("__id"), kept, pa.array(spans, span)]
        columns += [table.column(f.name) for f in kept_fields]
        return pa.table(columns, ["doc_id", "kept", "spans", *[f.name for f in kept_fields]])

    def ddl(schema: pa.Schema) -> str:
        return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)

    by_bucket = dealt.groupBy("bucket")
    repeated = (
        by_bucket.applyInArrow(send_triggers, ddl(TRIGGERS))
        .repartition(parts, "shard").groupBy("shard").applyInArrow(answer_triggers, ddl(REPEATED))
    )
    phrases = by_bucket.cogroup(repeated.groupBy("bucket")).applyInArrow(send_dictionary, ddl(DICTIONARY))
    found = phrases.repartition(parts, "shard").groupBy("shard").applyInArrow(answer_dictionary, ddl(FOUND))
    out = f"doc_id bigint, kept {'string' if as_text else 'binary'}, spans array<struct<start: bigint, end: bigint>>"
    out += "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept_fields)
    result = by_bucket.cogroup(found.groupBy("bucket")).applyInArrow(remove, out)
    return result.withColumnsRenamed({f"__keep_{c}": c for c in keep})
