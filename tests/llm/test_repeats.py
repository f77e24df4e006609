import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from frostgrid.llm.queries import QUERIES
from frostgrid.llm.repeats import Phrases, remove_repeats, rolling_hash, suffix_array
from frostgrid.sources import read_table

SCHEMA = "doc_id bigint, text string, bucket string, spans int"
SF_DIR = "/root/testdata/sf0.01"


def by_brute_force(rows, length=50):
    """(doc_id, bytes left, removed ranges) of every row."""
    texts = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for order, _, data in texts:
        for at in range(len(data) - length + 1):
            string = data[at:at + length]
            first[string] = min(first.get(string, order), order)
    out = []
    for order, i, data in texts:
        gone = np.zeros(len(data) + 2, bool)
        for at in range(len(data) - length + 1):
            if first[data[at:at + length]] < order:
                gone[at + 1:at + 1 + length] = True
        edges = np.nonzero(gone[1:] != gone[:-1])[0].tolist()
        spans = list(zip(edges[::2], edges[1::2]))
        left = bytes(b for b, g in zip(data, gone[1:]) if not g)
        out.append((i, left, spans))
    return sorted(out, key=repr)


def check(df, rows, **limits):
    got = [
        (r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in remove_repeats(df, **limits).collect()
    ]
    expected = by_brute_force(rows, limits.get("length", 50))
    assert sorted(got, key=repr) == expected


def test_rolling_hash_depends_on_the_bytes_alone():
    data = np.frombuffer(b"abcabcabcXabcabcabc" * 9, np.uint8)
    for gram in (1, 2, 7, 24, 50):
        found = {}
        for at, h in enumerate(rolling_hash(data, gram).tolist()):
            assert found.setdefault(bytes(data[at:at + gram]), h) == h
        assert len(set(found.values())) == len(found)
        assert len(rolling_hash(data, gram)) == len(data) - gram + 1


def test_phrases_hold_each_window_once_and_agree(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 49, 50, 51, 700, 300)] + ["a" * 200]
    for chunk in (1 << 15, 97):
        monkeypatch.setattr("frostgrid.llm.repeats.CHUNK", chunk)
        p = Phrases(pa.table({"__id": pa.array(range(len(texts)), pa.int64()), "__text": [t.encode() for t in texts]}), 50)
        seen = [at for a, b in zip(p.first, p.last) for at in range(a, b + 1)]
        wanted = [b + i for b, t in zip(p.begins, texts) for i in range(len(t) - 49)]
        assert sorted(seen) == sorted(wanted)
        trigger = {}
        for a, b, t in zip(p.first, p.last, p.trigger.tolist()):
            for at in range(a, b + 1):
                assert trigger.setdefault(bytes(p.data[at:at + 50]), t) == t


def test_phrases_do_not_depend_on_the_order_of_rows():
    """The rows of a bucket come in another order whenever executors fetch them anew."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcd ef") for _ in range(rng.choice([30, 900, 4000, 40000])))) for i in range(40)]

    def phrases(rows):
        table = pa.table({"__id": pa.array([i for i, _ in rows], pa.int64()), "__text": [t.encode() for _, t in rows]})
        p = Phrases(table, 50)
        return sorted(zip(p.ids[p.doc].tolist(), (p.first - p.begins[p.doc]).tolist(), p.key.tolist()))

    wanted = phrases(rows)
    for _ in range(3):
        rng.shuffle(rows)
        assert phrases(rows) == wanted


PASSAGE = "The quick brown fox jumps over the lazy dog, and then it does so once more. "
ODD = [
    (5, None), (4, ""), (3, "short"), (2, PASSAGE), (7, PASSAGE), (7, PASSAGE), (6, "x" + PASSAGE[5:60] + "y"),
    (None, PASSAGE + "end"), (None, PASSAGE + "end"), (8, "a" * 300), (9, "b" + "a" * 120 + "c"), (1, "a" * 55),
    (10, PASSAGE[:49]), (11, "é" * 40), (12, "xé" + "é" * 30), (13, PASSAGE * 40 + "tail"), (14, "zz" + PASSAGE * 41),
]


@pytest.mark.parametrize("limits", [{}, {"crowded": 0}, {"bucket_bytes": 100, "crowded": 3}, {"length": 32}, {"length": 70}])
def test_odd_rows(spark, limits):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in ODD], SCHEMA)
    check(df, ODD, **limits)


@pytest.mark.parametrize("length", [100, 500])
def test_phrases_that_differ_in_one_byte(spark, length):
    """Near copies, each other byte of which is changed in one document."""
    rng = random.Random(length)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3 * length))
    rows = [(0, base)]
    for i, at in enumerate(range(length // 2, 3 * length, max(length // 25, 7)), 1):
        rows.append((i, base[:at] + "#" + base[at + 1:]))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    check(df, rows, length=length)


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99 + seed, 600).astype(np.uint8)
    data[300:400] = data[100:200]
    start = rng.permutation(551)
    order, new = suffix_array(data, start, 50)
    strings = [data[i:i + 50].tobytes() for i in start[order]]
    assert strings == sorted(strings) and sorted(order) == list(range(551))
    assert new.tolist() == [True] + [a != b for a, b in zip(strings, strings[1:])]


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a", "x", 0)], SCHEMA)
    assert remove_repeats(df.where("false")).count() == 0
    kept = remove_repeats(df, keep=("bucket", "spans")).drop("spans")
    assert [tuple(r) for r in kept.collect()] == [(1, b"a", "x")] or kept.columns == ["doc_id", "kept", "bucket"]


def test_shared_passages_in_random_text(spark):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abc d") for _ in range(rng.randint(50, 90))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        rows.append((i * 7 % 120, parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[:rng.randint(1, 90)] + parts[2]))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    check(df, rows)
    check(df, rows, bucket_bytes=800, crowded=2)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_DIR, "documents").collect()]
    wanted = by_brute_force(rows)
    got = QUERIES["op1_suffix_array_dedup"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(
        (i, len(left) + (n := sum(b - a for a, b in spans)), n, len(spans), hashlib.sha256(left).hexdigest())
        for i, left, spans in wanted
    )
