"""Language of documents, by Bayesian fusion of several kinds of evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from frostgrid.llm.common import checkpointed, give_back, join_lookup

SAMPLE_ROWS = 4000
FEATURES = 1 << 13
UNKNOWN = "und"
# With more classes than this only the trigrams that occur are looked up.
MANY_CLASSES = 32
# Neighbouring trigrams share two of three bytes, so each counts as a third of one observation.
TEXT_WEIGHT = 1 / 3
PRIOR_ROWS = 10.0


def trigrams(text: bytes) -> np.ndarray:
    """How often each of the hashed byte trigrams of a text occurs, A-Z in lower case."""
    data = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(FEATURES, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=FEATURES)


class TextModel:
    """Log-probabilities of trigrams in each language and, in the last row, in noise."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        rows = [np.log((counts[name] + 0.5) / (counts[name].sum() + 0.5 * FEATURES)) for name in self.languages]
        self.log_probability = np.array([*rows, np.full(FEATURES, -np.log(FEATURES))])

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UNKNOWN]

    def log_likelihood(self, text: bytes | None) -> np.ndarray:
        counts = trigrams(text or b"")
        if len(self.log_probability) > MANY_CLASSES:
            seen = np.nonzero(counts)[0]
            return TEXT_WEIGHT * (self.log_probability[:, seen] @ counts[seen])
        return TEXT_WEIGHT * (self.log_probability @ counts)


def as_language(declared: str | Column) -> Column:
    """The language of a tag as in markup: ``EN-us`` is ``en``; null if it does not begin with two to eight letters."""
    column = F.col(declared) if isinstance(declared, str) else declared
    tag = F.lower(F.trim(F.split(column.cast("string"), "[-_]")[0]))
    return F.when(tag.rlike("^[a-z]{2,8}$"), tag)


def markup_language(html: str | Column) -> Column:
    """What the ``lang`` or ``xml:lang`` of the ``html`` element declares; null where there is none."""
    column = F.col(html) if isinstance(html, str) else html
    tag = F.regexp_extract(column, r"""(?i)<html(?=\s)[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z0-9_-]+)""", 1)
    return F.when(tag != "", tag)


def fit_text_model(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> TextModel:
    """Fit on about ``sample_rows`` texts of every label, chosen by their hash, each read whole and once.

    Labels and their numbers of distinct texts come from all rows. A label of
    up to ``sample_rows`` texts is read in full; of a larger one the share
    ``sample_rows`` / texts is drawn, and always the text with the least hash,
    so every label of the table is a class, however rare. Copies count as one
    text, so that none of them outweighs the others. Counts are made per label
    and part of the sample and summed; the driver gets, for each label, one
    vector of ``FEATURES`` numbers.
    """
    labelled = docs.select(as_language(label_col).alias("label"), F.col(text_col).cast("binary").alias("text")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("label") != UNKNOWN)
    )
    parts = 1 << 40
    labelled = labelled.withColumn("hash", F.xxhash64("text")).withColumn("part", F.pmod("hash", F.lit(parts)))
    quota = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.count(F.lit(1)))
    last = F.greatest(F.min("part"), (quota * parts).cast("bigint") - 1)
    texts = labelled.select("label", "hash", "part").distinct()
    labels = checkpointed(texts.groupBy("label").agg(last.alias("last")))
    drawn = join_lookup(labelled, labels, "label", F.col("text"), "inner").where(F.col("part") <= F.col("last"))
    sample = drawn.groupBy("label", "part", "hash").agg(F.min("text").alias("text"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((trigrams(t) for t in rows["text"]), np.zeros(FEATURES, np.int64))
        return pd.DataFrame({"label": rows["label"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    counted = sample.withColumn("part", F.col("part") % 8).groupBy("label", "part").applyInPandas(
        count, "label string, counts binary"
    )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in rows["counts"])
        return pd.DataFrame({"label": rows["label"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    summed = counted.groupBy("label").applyInPandas(add, "label string, counts binary")
    return TextModel({row.label: np.frombuffer(row.counts, "<i8") for row in summed.collect()})


def _with_likelihood(docs: DataFrame, model: TextModel, text_col: str, told: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``__ll``, the weighted log-likelihood of the text under each class, and ``__own``, what follows from it alone.

    With ``told``, also with ``__told``: its row for the language in ``__declared``, zeros where that is null.
    """
    added = ["__ll", "__own"] if told is None else ["__ll", "__own", "__told"]
    schema = StructType([*docs.schema.fields, *[StructField(name, ArrayType(DoubleType())) for name in added]])
    at = docs.columns.index(text_col)
    row_of = {name: i for i, name in enumerate(model.languages)}
    declared = docs.columns.index("__declared") if told is not None else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            scores = [model.log_likelihood(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts]
            weights = [np.exp(ll - ll.max()) for ll in scores]
            numbers = [scores, [w / w.sum() for w in weights]]
            columns = [*batch.columns, *[pa.array(n, pa.list_(pa.float64())) for n in numbers]]
            if told is not None:
                silent = np.zeros(len(model.classes))
                tags = batch.column(declared).to_pylist()
                columns.append(pa.array([told[row_of[t]] if t in row_of else silent for t in tags], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])
        give_back()

    return docs.mapInArrow(score, schema)


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _share(counts: Column, own: Column, parent: Column) -> Column:
    """Class shares of a group without the row itself, drawn towards those of its parent.

    The parent counts as ``PRIOR_ROWS`` rows.
    """
    left = F.zip_with(counts, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    total = F.aggregate(left, F.lit(PRIOR_ROWS), lambda s, x: s + x)
    return F.zip_with(left, parent, lambda n, p: (n + PRIOR_ROWS * p) / total)


def fused(
    docs: DataFrame,
    model: TextModel,
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    domain_col: str | None = None,
    suffix_col: str | None = None,
    least: float = 0.5,
) -> DataFrame:
    """``docs`` with ``__language``, ``__posterior`` and ``__accepted``.

    The posterior of a language is in proportion to its text likelihood, its
    prior at the host, the chance that its documents declare what this one
    does, and its share under the address suffix against its share overall.
    All shares are sums of text-only posteriors over all documents, by host,
    domain, suffix and declaration, always without the row itself: a host is
    smoothed towards its domain, a domain and a suffix towards the corpus. What
    is null is no evidence. A row is accepted if its best class is a language,
    not noise, with a posterior of ``least`` or more.

    Texts are read twice and never shuffled, unless hosts are too many for a
    broadcast. A table without labels knows no language and accepts nothing.
    """
    # Whatever the columns are called, they stand aside from those added here.
    names_of = docs.columns
    aside = {name: f"column_{i}" for i, name in enumerate(names_of)}
    docs = docs.toDF(*aside.values())
    text_col, declared_col, host_col, domain_col, suffix_col = (
        aside[c] if c else None for c in (text_col, declared_col, host_col, domain_col, suffix_col)
    )
    classes = model.classes
    k = len(classes)
    none = F.lit(None).cast("string")
    names = {"__declared": declared_col, "__host": host_col, "__domain": domain_col, "__suffix": suffix_col}
    tag = as_language(declared_col) if declared_col else none
    known = F.when(tag.isin(model.languages), tag) if model.languages else none
    keyed = docs.withColumns(
        {n: known if n == "__declared" else F.col(c).cast("string") if c else none for n, c in names.items()}
    )
    slim = keyed.select(F.col(text_col).alias("__text"), *names)
    scored = _with_likelihood(slim, model, "__text").drop("__text")
    sums = F.array(*[F.coalesce(F.sum(F.col("__own")[i]), F.lit(0.0)) for i in range(k)]).alias("__n")
    # Every other share is a sum over these groups.
    groups = checkpointed(scored.groupBy(*names).agg(sums))
    resum = F.array(*[F.coalesce(F.sum(F.col("__n")[i]), F.lit(0.0)) for i in range(k)])

    totals = groups.agg(resum.alias("n")).collect()[0]["n"]
    corpus = [(n + 1 / k) / (sum(totals) + 1) for n in totals]
    shares = F.array(*map(F.lit, corpus))

    by_declared = {r["__declared"]: r["n"] for r in groups.groupBy("__declared").agg(resum.alias("n")).collect()}
    told = {name: by_declared.get(name, [0.0] * k) for name in model.languages}
    rows = [sum(told[name][i] for name in model.languages) for i in range(k)]

    # For each language declared, and each class, the chance that documents of the class declare it;
    # at first nine in ten for their own.
    own = np.full((len(model.languages), k), 0.1 / max(len(model.languages) - 1, 1))
    own[np.arange(len(model.languages)), np.arange(len(model.languages))] = 0.9
    own[:, -1] = 1 / max(len(model.languages), 1)
    seen = np.array([told[name] for name in model.languages]).reshape(-1, k)
    chances = np.log((seen + PRIOR_ROWS * own) / (np.array(rows) + PRIOR_ROWS))

    evidence = _with_likelihood(keyed, model, text_col, chances)
    prior = shares
    if domain_col:
        domains = checkpointed(groups.where("__domain is not null").groupBy("__domain").agg(resum.alias("__dn")))
        evidence = join_lookup(evidence, domains, "__domain", F.col(text_col))
        prior = F.coalesce(_share(F.col("__dn"), F.col("__own"), shares), shares)
    if host_col:
        hosts = checkpointed(groups.where("__host is not null").groupBy("__host").agg(resum.alias("__hn")))
        evidence = join_lookup(evidence, hosts, "__host", F.col(text_col))
        prior = F.coalesce(_share(F.col("__hn"), F.col("__own"), prior), prior)
    log = lambda shares: F.transform(shares, lambda p: F.log(p))
    score = _added(F.col("__ll"), log(prior))
    if suffix_col:
        suffixes = checkpointed(groups.where("__suffix is not null").groupBy("__suffix").agg(resum.alias("__sn")))
        evidence = join_lookup(evidence, suffixes, "__suffix", F.col(text_col))
        ratio = F.zip_with(_share(F.col("__sn"), F.col("__own"), shares), shares, lambda p, q: F.log(p / q))
        score = F.coalesce(_added(score, ratio), score)
    score = _added(score, F.col("__told"))

    evidence = evidence.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    best = F.array_position("__score", F.col("__top")).cast("int")
    language = F.element_at(F.array(*map(F.lit, classes)), best)
    posterior = 1 / F.aggregate("__score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__top")))
    return evidence.select(
        *[F.col(a).alias(name) for name, a in aside.items()], language.alias("__language"), posterior.alias("__posterior"),
        ((language != UNKNOWN) & (posterior >= least)).alias("__accepted"),
    )


def identify_language(docs: DataFrame, model: TextModel, id_col: str = "doc_id", **columns: str | None) -> DataFrame:
    """One row per document: ``doc_id``, ``language``, ``posterior`` and ``accepted``; see :func:`fused`."""
    named = {"text_col": "text", "declared_col": "lang", "host_col": "source", **columns}
    used = [c for n, c in named.items() if n.endswith("_col") and c and c != id_col]
    return fused(docs.select(id_col, *dict.fromkeys(used)), model, **named).select(
        F.col(id_col).alias("doc_id"), F.col("__language").alias("language"),
        F.col("__posterior").alias("posterior"), F.col("__accepted").alias("accepted"),
    )
