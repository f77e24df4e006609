import math
import random
import re
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostgrid.llm.language import (
    UNKNOWN, TextModel, as_language, fit_text_model, fused, identify_language, markup_language, trigrams,
)
from frostgrid.llm.queries import QUERIES
from frostgrid.llm.urls import domain_of, host_of, suffix_of
from frostgrid.sources import read_table

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_DIR, "documents")


@pytest.fixture(scope="module")
def model(docs):
    return fit_text_model(docs.where("doc_id % 2 = 0"), sample_rows=300)


def soft(x):
    w = [math.exp(v - max(x)) for v in x]
    return [v / sum(w) for v in w]


def plain(rows, model, m=10.0, least=0.5):
    """Rows are (id, text, declared, host, domain, suffix)."""
    classes, k = model.classes, len(model.classes)
    ll = [model.log_likelihood(r[1].encode() if r[1] is not None else None).tolist() for r in rows]
    own = [soft(x) for x in ll]
    tag = [None if r[2] is None else r[2].replace("_", "-").split("-")[0].strip().lower() for r in rows]
    tag = [t if t in model.languages else None for t in tag]

    def total(test):
        return [sum(o[i] for r, o, t in zip(rows, own, tag) if test(r, t)) for i in range(k)]

    def share(counts, o, parent):
        left = [max(n - x, 0) for n, x in zip(counts, o)]
        return [(n + m * p) / (sum(left) + m) for n, p in zip(left, parent)]

    everything = total(lambda r, t: True)
    corpus = [(n + 1 / k) / (sum(everything) + 1) for n in everything]
    told = {name: total(lambda r, t: t == name) for name in model.languages}
    out = []
    for r, x, o, t in zip(rows, ll, own, tag):
        prior = corpus
        if r[4] is not None:
            prior = share(total(lambda q, _: q[4] == r[4]), o, prior)
        if r[3] is not None:
            prior = share(total(lambda q, _: q[3] == r[3]), o, prior)
        score = [a + math.log(p) for a, p in zip(x, prior)]
        if r[5] is not None:
            s = share(total(lambda q, _: q[5] == r[5]), o, corpus)
            score = [a + math.log(p / q) for a, p, q in zip(score, s, corpus)]
        if t is not None:
            for i, c in enumerate(classes):
                guess = 1 / len(model.languages) if c == UNKNOWN else 0.9 if c == t else 0.1 / max(len(model.languages) - 1, 1)
                n = sum(told[name][i] for name in model.languages)
                score[i] += math.log((told[t][i] + m * guess) / (n + m))
        chance = soft(score)
        best = max(range(k), key=lambda i: chance[i])
        out.append((r[0], classes[best], round(chance[best], 6), classes[best] != UNKNOWN and chance[best] >= least))
    return sorted(out, key=repr)


def check(spark, rows, model):
    df = spark.createDataFrame(
        [(*r, 0, "x") for r in rows],
        "doc_id bigint, text string, lang string, source string, domain string, suffix string, language int, posterior string",
    )
    got = identify_language(df, model, domain_col="domain", suffix_col="suffix").collect()
    assert sorted(((r.doc_id, r.language, round(r.posterior, 6), r.accepted) for r in got), key=repr) == plain(rows, model)
    return df


ENGLISH = "the and that of the with this for are being and there is in the other of "
GERMAN = "der die und nicht auch für ich über sch ein eine mit das ist von den "


@pytest.mark.parametrize("rows_for_broadcast", [10_000, 0])
def test_fusion_against_plain_python(spark, model, monkeypatch, rows_for_broadcast):
    monkeypatch.setattr("frostgrid.llm.common.BROADCAST_ROWS", rows_for_broadcast)
    rows = [
        (1, ENGLISH, "EN-us", "a", "x.org", "org"), (2, GERMAN, "de", "b", "x.org", "de"), (3, None, None, None, None, None),
        (4, "", "de", "b", None, "de"), (5, "zz", "xx", "b", "x.org", "de"), (6, ENGLISH * 4000, None, "a", None, None),
        (7, "%#%# 12 ~~ " * 20, "en", "a", "x.org", "org"), (8, GERMAN, "en", "a", "x.org", "org"),
        (8, GERMAN, "en", "a", "x.org", "org"), (None, "un", None, "b", "y", "de"), (9, "in", " FR_fr", "c", "y", ""),
    ]
    df = check(spark, rows, model)
    assert identify_language(df.where("false"), model).count() == 0


def test_noise_is_not_a_language(spark, model):
    rng = np.random.default_rng(3)
    noise = "".join(map(chr, rng.integers(33, 64, 3000)))
    df = spark.createDataFrame([(1, noise, "en", "s"), (2, ENGLISH * 5, "en", "s")], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.accepted for r in identify_language(df, model).collect()} == {1: False, 2: True}


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, "s")], "doc_id bigint, text string, lang string, source string")
    found = identify_language(df, fit_text_model(df)).collect()
    assert [(r.doc_id, r.language, r.accepted) for r in found] == [(1, UNKNOWN, False)]


def test_held_out_accuracy_and_kept_documents(docs, model):
    held = docs.where("doc_id % 2 = 1")
    found = identify_language(held.drop("lang"), model, declared_col=None)
    both = found.join(held.select("doc_id", "lang"), "doc_id")
    right, kept, n = both.agg(
        F.avg((F.col("language") == F.col("lang")).cast("double")), F.avg(F.col("accepted").cast("double")), F.count("*")
    ).collect()[0]
    assert n > 400 and right >= 0.97 and kept >= 0.99
    # What goes is full of symbols; plain prose stays.
    symbols = F.length(F.regexp_replace("text", r"[^#$%&*!0-9@|_+-]", "")) / F.length("text")
    gone = identify_language(docs, model).where("not accepted").join(docs.select("doc_id", symbols.alias("share")), "doc_id")
    assert gone.count() <= 10 and gone.where("share < 0.1").count() == 0


def test_markup_pages(spark, model):
    pages = read_table(spark, SF_DIR, "pages")
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    df = pages.select(
        "page_id", "html", F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("tag"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"([^.]+)$", 1).alias("tld"),
    )
    found = identify_language(
        df, model, "page_id", text_col="html", declared_col="tag", host_col="host", domain_col="domain", suffix_col="tld"
    )
    agree = found.join(df.select(F.col("page_id").alias("doc_id"), "tag"), "doc_id").where("language = tag").count()
    assert agree >= 0.8 * df.count()


@pytest.mark.parametrize("rows_for_broadcast", [10_000, 0])
def test_every_label_has_its_own_quota(spark, monkeypatch, rows_for_broadcast):
    monkeypatch.setattr("frostgrid.llm.common.BROADCAST_ROWS", rows_for_broadcast)
    rare = "zxq qxz vvk kkv zzx xqq " * 3
    rows = [(i, f"{ENGLISH} {i}", "en", "a") for i in range(3000)] + [(i, f"{GERMAN} {i}", "de", "a") for i in range(3000, 4000)]
    rows += [(4000 + i, f"{rare} {i}", "tlh", "b") for i in range(5)] + [(5000, "yy ww yy ww", "sw", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = fit_text_model(df, sample_rows=100)
    assert model.languages == ["de", "en", "sw", "tlh"]
    # A rare label is read in full.
    count = lambda texts: sum(trigrams(t.encode()) for t in texts)
    whole = TextModel({"tlh": count([r[1] for r in rows if r[2] == "tlh"]), "sw": count(["yy ww yy ww"])})
    for name in whole.languages:
        assert np.allclose(model.log_probability[model.languages.index(name)], whole.log_probability[whole.languages.index(name)])
    found = {r.doc_id: (r.language, r.accepted) for r in identify_language(df, model).collect()}
    assert all(found[r[0]] == ("tlh", True) for r in rows if r[2] == "tlh") and found[0] == ("en", True)
    # With a quota of one, a label is still never without a text.
    assert fit_text_model(df, sample_rows=1).languages == model.languages


def test_query_judges_documents_and_pages_by_all_evidence(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = QUERIES["op6_language_id"](spark, sf_dir).collect()
    docs, pages = (read_table(spark, sf_dir, t) for t in ("documents", "pages"))
    assert sorted(r.doc_id for r in found if r.page_id is None) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    rows = []
    for r in pages.collect():
        host = urlsplit(r.url).hostname
        tag = re.search(r'<html lang="([^"]*)"', r.html)
        rows.append((r.page_id, r.html, tag and tag[1], host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    model = fit_text_model(spark.createDataFrame([(r[1], r[2]) for r in rows], "text string, lang string"))
    got = sorted((r.page_id, r.language, r.posterior, r.accepted) for r in found if r.doc_id is None)
    wanted = plain(rows, model)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in sorted(wanted)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(wanted)], atol=2e-6)
    agree = sum(g[1] == r[2] for g, r in zip(got, sorted(rows)))
    assert agree >= 0.95 * len(rows)


def test_evidence_of_a_page(spark):
    rows = [
        ('<!DOCTYPE html>\n<HTML class="a" LANG=\'de-AT\'>', "https://u@M.Shop.Example.at:80/x", "de-AT", "m.shop.example.at", "example.at", "at"),
        ('<html data-lang="xx" xml:lang=fr dir=ltr>', "http://example.fr", "fr", "example.fr", "example.fr", "fr"),
        ('<html><p lang="es">', "http://10.0.0.1/a", None, "10.0.0.1", None, None), (None, "localhost", None, None, None, None),
        ('<html lang="">', "http://localhost/", None, "localhost", None, None), ("<htmlx lang=en>", "http://[::1.2]/", None, "[::1.2]", None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "html string, url string")
    host = host_of("url")
    got = df.select("html", "url", markup_language("html"), host, domain_of(host), suffix_of(host)).collect()
    assert [tuple(r) for r in got] == rows


def test_copies_count_once_in_the_sample(spark):
    rows = [(i, ENGLISH if i % 3 else f"{GERMAN} {i % 30}", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit_text_model(df, sample_rows=100)
    once = TextModel({"en": sum(trigrams(t.encode()) for t in {r[1] for r in rows})})
    assert np.allclose(model.log_probability, once.log_probability)


def labelled_rows(spark, labels, rows):
    """Short texts whose words are of their label alone."""
    rng = random.Random(5)
    names = [f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" + "x" * (i // 676) for i in range(labels)]
    words = {n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for n in names}
    out = []
    for i in range(rows):
        name = names[i % labels]
        out.append((i, " ".join(rng.choice(words[name]) for _ in range(30)), name if i // labels != 4 else "<junk 1>", f"s{i % 9}", None, "x"))
    schema = "doc_id bigint, text string, lang string, source string, __host string, __own string"
    return names, spark.createDataFrame(out, schema)


def test_many_labels_and_columns_of_names_used_inside(spark):
    """Five hundred labels, a rare one among them, and tags that are none."""
    names, docs = labelled_rows(spark, 500, 3000)
    assert fit_text_model(docs).languages == sorted(names)
    found = fused(docs, fit_text_model(docs)).collect()
    assert len(found) == 3000 and sum(r["__language"] == names[r.doc_id % 500] for r in found) > 2900


@pytest.mark.parametrize("tag, wanted", [("EN-us", "en"), (" fr ", "fr"), ("", None), (None, None), ("x", None), ("<de>", None), ("12", None), ("zh_Hant", "zh")])
def test_tags(spark, tag, wanted):
    df = spark.createDataFrame([(tag,)], "t string")
    assert df.select(as_language("t")).collect()[0][0] == wanted
