import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frostgrid.llm.packing import (
    CapacityTree, best_fit_decreasing, pack_sequences, packed_matrices, sum_of_squares, token_pieces,
)
from frostgrid.llm.queries import word_tokenizer
from frostgrid.llm.tokens import WordEncoder
from frostgrid.sources import read_table

SCHEMA = "doc_id bigint, text string, length int, shard string"


@cache
def plain_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(text):
    return plain_tokenizer().encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    every = "".join(map(chr, range(1, 0x250)))
    yield from ["", " ", "It's 'RE we'll ''s 'tis", every, every[::-1], "<|endoftext|> a", "İstanbul", "é", "日本 x", "— “q” …   z", "ΣΑΣ", "a\x1cb\x85c\xa0d", "½²x9", "A" * 5000]
    for _ in range(300):
        yield "".join(rng.choice(every + "'' sdrel  ") for _ in range(rng.randint(1, 60)))


def test_words_encode_as_texts(monkeypatch):
    encode = WordEncoder(word_tokenizer()).encode
    for text in odd_texts():
        assert encode(text).tolist() == plain_ids(text), repr(text)
    monkeypatch.setattr("frostgrid.llm.tokens.KNOWN_WORDS", 50)
    for text in odd_texts():
        assert encode(text).tolist() == plain_ids(text), repr(text)


def test_another_kind_of_tokenizer():
    content = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    whole = Tokenizer.from_str(content)
    encode = WordEncoder(content).encode
    assert encode("Some  text, 12").tolist() == whole.encode("Some  text, 12", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_both_packers_fill_without_overlap(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 30, 700)
    sequence, offset = sum_of_squares(lengths, 64)
    for members in (np.nonzero(sequence == s)[0] for s in np.unique(sequence)):
        order = members[np.argsort(offset[members])]
        ends = np.cumsum(lengths[order])
        assert ends[-1] <= 64 and (offset[order] == ends - lengths[order]).all()
    bins = best_fit_decreasing(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(700))
    assert all(lengths[b].sum() <= 64 for b in bins)
    assert max(len(bins), sequence.max() + 1) <= 1.03 * lengths.sum() / 64 + 1


def test_each_step_of_sum_of_squares_is_the_least():
    lengths = np.random.default_rng(1).integers(1, 30, 80)
    sequence, _ = sum_of_squares(lengths, 40)
    left = {}
    squares = lambda d: sum(list(d.values()).count(g) ** 2 for g in set(d.values()) if g)
    for i in np.argsort(-lengths, kind="stable"):
        s, number = int(lengths[i]), int(sequence[i])
        rooms = [k for k, g in left.items() if g >= s]
        assert (number in left) == bool(rooms)
        moved = {k: squares({**left, k: left[k] - s}) for k in rooms}
        left[number] = left.get(number, 40) - s
        assert not rooms or squares(left) == min(moved.values())


def test_capacity_search():
    rng, tree, plain = random.Random(2), CapacityTree(50), []
    for number in range(2000):
        if rng.random() < 0.5:
            capacity = rng.randint(0, 50)
            tree.add(capacity, number)
            plain.append((capacity, number))
        else:
            length = rng.randint(0, 50)
            found = tree.take(length)
            fits = sorted(c for c, _ in plain if c >= length)
            assert (found is None) == (not fits)
            if found:
                assert found[0] == fits[0] and found in plain
                plain.remove(found)


def expected_pieces(rows, seq_len):
    out = []
    for i, text in rows:
        ids = [*plain_ids(text), 0]
        for p, start in enumerate(range(0, len(ids), seq_len)):
            part = np.array(ids[start:start + seq_len], "<u4")
            out.append((i, p, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_pieces(df, rows, seq_len=2048, **limits):
    got = pack_sequences(token_pieces(df, word_tokenizer(), seq_len), seq_len, **limits).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == expected_pieces(rows, seq_len)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(filled), sum(r.length for r in got)


ODD = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "word " * 9000), (4, "a b"), (4, "a b"), (5, "日本 é")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in ODD], SCHEMA)
    check_pieces(df, ODD, shard_pieces=2)
    assert pack_sequences(token_pieces(df.where("false"), word_tokenizer())).count() == 0
    check_matrices(df, ODD)
    assert packed_matrices(df.where("false"), word_tokenizer(), 49_408).count() == 0


def check_matrices(df, rows, **limits):
    seq_len = limits.get("seq_len", 2048)
    found = defaultdict(dict)
    got = packed_matrices(df, word_tokenizer(), limits.pop("vocabulary", 49_408), **limits).collect()
    for r in got:
        kind = {2: "<u2", 4: "<u4"}[r.id_bytes]
        ids, positions = np.frombuffer(r.input_ids, kind), np.frombuffer(r.position_ids, kind)
        assert len(ids) == len(positions) == seq_len
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens:].any()
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            found[doc].setdefault(piece, []).append(ids[a:b].tolist())
    wanted = defaultdict(dict)
    for i, text in rows:
        ids = [*plain_ids(text), 0]
        for p, start in enumerate(range(0, len(ids), seq_len)):
            wanted[i].setdefault(p, []).append(ids[start:start + seq_len])
    assert {k: {p: sorted(x) for p, x in v.items()} for k, v in found.items()} == {
        k: {p: sorted(x) for p, x in v.items()} for k, v in wanted.items()
    }
    return len(got), sum(r.n_tokens for r in got)


def test_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    used, tokens = check_pieces(df, rows)
    assert used <= tokens / 2048 * 1.002 + 1
    used, tokens = check_matrices(df.coalesce(1), rows)
    assert used <= tokens / 2048 * 1.002 + 1


def test_narrow_rows_and_small_buffers(spark):
    rows = [(i, "some words of a text " * (i % 30)) for i in range(200)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    check_pieces(df, rows, 64, shard_pieces=50)
    check_matrices(df, rows, seq_len=64, buffer_tokens=500, vocabulary=100_000)
