import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from frostgrid.llm import minhash
from frostgrid.llm.minhash import parity_sketch, shingles, similar_groups, similarity
from frostgrid.llm.simhash import majority
from frostgrid.sources import read_table
from tests.llm.test_simhash import plain_roots

SCHEMA = "doc_id bigint, text string"


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def by_brute_force(rows):
    sets = [plain_shingles(r[1]) for r in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    root = plain_roots(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(((r[0], least.get(root[i])) for i, r in enumerate(rows)), key=repr)


def one_word_changed(rng, n_words, n_changes):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    other = list(words)
    for at in range(n_changes):
        other[7 + 11 * at] = "changed"
    return " ".join(words), " ".join(other)


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(None, "a b c"), (3, "A b  C"), (4, None), (5, " "), (6, "a b c d"), (7, "a b c"), (None, "only one without an id")]
    for i in range(60):
        a, b = one_word_changed(rng, 100, i % 4)
        rows += [(100 + 2 * i, a), (101 + 2 * i, b)]
    got = similar_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_brute_force(rows)
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_against_brute_force(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = similar_groups(docs).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_brute_force(rows)


def test_chain_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:3 * i % 150] + [f"x{i}"] + base[3 * i % 150:])) for i in range(80)]
    got = similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0}


def crowd(n_docs, n_pairs, seed=3):
    """Documents that share a passage and are about 0.69 alike, and pairs among them that are 0.8 alike or a little more."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(160)]
    rows = []
    for i in range(n_docs):
        own = [word() for _ in range(36)]
        rows.append([i, passage + own])
        if i < n_pairs:
            near = list(own)
            near[4], near[14], near[24] = word(), word(), word()
            rows.append([n_docs + i, passage + near[:-2] + [word(), word()]])
    return [(i, " ".join(words)) for i, words in rows]


def test_no_pair_of_a_crowd_is_lost(spark):
    """Nearly all pairs of 8,000 documents meet in some bucket, 100 of them are alike, and no more."""
    rows = crowd(8000, 100)
    sets = {i: plain_shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 <= alike(i, 8000 + i) < 0.88 for i in range(100)) and 0.6 < alike(200, 201) < 0.75
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - 8000 if i >= 8000 else i for i, _ in rows}


def test_lists_of_common_shingles_are_compared_slice_by_slice(spark, monkeypatch):
    """Documents put together from few templates have no rare shingles."""
    monkeypatch.setattr(minhash, "SLICE_ROWS", 3)
    monkeypatch.setattr(minhash, "RARE_ROWS", 2)
    rng = random.Random(8)
    templates = [" ".join(f"t{k}x{i}" for i in range(30)) for k in range(14)]
    rows = [(i, " ".join(templates[k] for k in sorted(rng.sample(range(14), 10)))) for i in range(250)]
    got = similar_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_brute_force(rows)


def test_few_links_are_handed_to_components(spark, monkeypatch):
    """A group of near copies costs about a link for each member, however many buckets they share."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rng.randrange(300)] = f"own{i}"
        rows.append((i, " ".join(words)))
    seen = []
    components = minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: (seen.append(links.count()), components(links))[1])
    got = similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {0} and max(seen) < 6 * len(rows)


def test_steps_on_few_rows_leave_few_files(spark, tmp_path):
    """Steps take tasks by their rows, also where the session has many partitions and merges none."""
    rng = random.Random(14)
    rows = crowd(60, 10) + [(1000 + 2 * i + k, t) for i in range(20) for k, t in enumerate(one_word_changed(rng, 100, 1))]
    docs = spark.createDataFrame(rows, SCHEMA)
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in many}
    try:
        for name, value in many.items():
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("few rows", "")
        got = similar_groups(docs).select("doc_id", "component_id").collect()
        told = spark.sparkContext.statusTracker()
        stages = {s for j in told.getJobIdsForGroup("few rows") for s in told.getJobInfo(j).stageIds}
        ran = [info.numCompletedTasks for info in map(told.getStageInfo, stages) if info]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted((tuple(r) for r in got), key=repr) == by_brute_force(rows)
    assert len(ran) > 20 and sum(n >= 40 for n in ran) < len(ran) / 4


def test_links_of_fingerprints_alone_are_enough(spark, monkeypatch):
    """Near copies that meet in no band are found by the tree over their fingerprints."""
    rng = random.Random(12)
    rows = [(2 * i + k, t) for i in range(30) for k, t in enumerate(one_word_changed(rng, 1500, 1))]
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: [hash((hashes.tobytes(), b)) for b in range(20)])
    sets = [shingles(t.encode()) for _, t in rows]
    near = [(int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(*[iter(map(majority, sets))] * 2)]
    assert sum(near) > 20
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(30) if near[i])


def test_stage_deals_texts_out_once_unless_ids_repeat(spark, tmp_path):
    rng = random.Random(13)
    rows = [(2 * i + k, t) for i in range(5) for k, t in enumerate(one_word_changed(rng, 100, 1))]
    for name, more in (("single", []), ("repeated", rows[:1])):
        spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{tmp_path}/{name}")
        left = pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/{name}"), "")
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == (1 if name == "single" else 2)
        assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 6, 8]


def test_stage_drops_a_document_with_one_changed_word(spark):
    rng = random.Random(1)
    rows = [(2 * i + k, t, "en", "a", 1) for i in range(50) for k, t in enumerate(one_word_changed(rng, 100, 1))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [2 * i for i in range(50)]


@pytest.mark.parametrize("text", [None, "", "One", "A bc d e f g", "w " * 20000])
def test_shingles_of_a_text(text):
    assert len(shingles(text.encode() if text is not None else None)) == len(plain_shingles(text))
    assert similarity(shingles(b""), shingles(None)) == 1


@pytest.mark.parametrize("size", [0, 1, 40, 700, 5000])
def test_sketches_differ_in_no_more_bits_than_sets_in_members(size):
    rng = np.random.default_rng(size)
    for changed in (0, 1, size // 5, size):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.append(a[changed:], rng.integers(0, 2**64, changed, dtype=np.uint64)))
        differing = parity_sketch(a) ^ parity_sketch(b)
        bits = sum(int(x).bit_count() for x in differing.view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and len(differing) == minhash.SKETCH_WORDS


def test_stage_judges_repeated_ids_by_their_texts(spark):
    rng = random.Random(2)
    (a, near_a), (b, near_b), (c, _) = (one_word_changed(rng, 100, 1) for _ in range(3))
    rows = [
        (1, a, "en", "s", 1), (5, near_a, "en", "s", 1), (5, b, "en", "s", 1), (5, c, "en", "t", 1), (5, c, "en", "s", 1),
        (7, near_b, "en", "s", 1), (None, near_b, "en", "s", 1), (8, None, "en", "s", 1), (8, "", "en", "s", 1), (None, "no id", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [tuple(r) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    empty = [r for r in got if r[0] == 8]
    assert len(empty) == 1 and not empty[0][1]
    assert sorted((r for r in got if r[0] != 8), key=repr) == sorted([rows[0], rows[2], rows[4], rows[9]], key=repr)


def test_stage_with_columns_of_its_own_names(spark):
    rng = random.Random(4)
    a, near_a = one_word_changed(rng, 100, 1)
    rows = [(1, a, 1, 2, {"k": 1}, True), (2, near_a, 1, 2, {}, False), (3, "other", 5, 6, None, None), (3, "other", 5, 6, {"a": 2}, None)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, of_id int, copies int, row map<string,int>, dropped boolean"
    )
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
