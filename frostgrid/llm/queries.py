"""One query per operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostgrid.llm.ann import nearest_neighbours
from frostgrid.llm.conversations import conversation_digests, repair_conversations
from frostgrid.llm.hard_negatives import hard_negatives
from frostgrid.llm.harmonic import harmonic_sequences
from frostgrid.llm.language import fit_text_model, identify_language, markup_language
from frostgrid.llm.maxscore import inner_product_top_k
from frostgrid.llm.mixing import mix_sources
from frostgrid.llm.oracle import ORACLE_SQL
from frostgrid.llm.packing import pack_sequences, packed_matrices, token_pieces
from frostgrid.llm.repeats import remove_repeats
from frostgrid.llm.revisits import resolve_revisits
from frostgrid.llm.simhash import simhash_groups
from frostgrid.llm.url_filters import filter_captures
from frostgrid.llm.urls import domain_of, host_of, suffix_of
from frostgrid.sources import read_table

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
SOURCE_WEIGHTS = [3.0, 1.0, 2.0]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of one and a half times the corpus takes of every document, and the words of each output shard."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)
    shards = F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["shard"], s["words"])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def word_tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    zero = F.lit(0).cast("bigint")
    n_removed = F.aggregate("spans", zero, lambda n, span: n + span["end"] - span["start"])
    return left.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces in sequences of 2048 tokens."""
    return pack_sequences(token_pieces(read_table(spark, sf_dir, "documents"), word_tokenizer()))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every page.

    A document is judged by its text, its declared language and its source. It
    has no URL, and so neither a domain above its host nor an address suffix.
    A page is judged by its whole html, the language its markup declares, its
    host, the domain above that and the suffix; its text model is fitted to
    pages, whose markup would pass for noise among documents. ``doc_id`` is
    null for pages, ``page_id`` for documents.
    """
    docs = read_table(spark, sf_dir, "documents")
    of_docs = identify_language(docs, fit_text_model(docs)).withColumn("page_id", F.lit(None).cast("bigint"))
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", "html", markup_language("html").alias("declared"), host_of("url").alias("host")
    )
    placed = pages.withColumns({"domain": domain_of("host"), "suffix": suffix_of("host")})
    of_pages = identify_language(
        placed, fit_text_model(placed, "html", "declared"), "page_id", text_col="html", declared_col="declared",
        host_col="host", domain_col="domain", suffix_col="suffix",
    )
    of_pages = of_pages.withColumns({"page_id": F.col("doc_id"), "doc_id": F.lit(None).cast("bigint")})
    return of_docs.unionByName(of_pages).withColumn("posterior", F.round("posterior", 6))


@query
def op7_packed_id_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in packed rows of 2048 token ids."""
    return packed_matrices(read_table(spark, sf_dir, "documents"), word_tokenizer(), vocabulary=49_408)


@query
def op9_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by integer inner product for every twentieth vector."""
    return inner_product_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each positive of every fiftieth vector, every seventh labelled as the next class."""
    vectors = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def byte_tokenizer() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


@query
def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces in sequences of at most 2048 tokens, hardly padded."""
    placed = harmonic_sequences(read_table(spark, sf_dir, "documents"), byte_tokenizer())
    return placed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which some are dropped, emptied, cut, repeated or given to the user, by a checksum of their key."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(fault == 4, "user").otherwise(text_of("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    changed = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return changed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, its turns damaged, with its faults and the cheapest repair."""
    turns = read_table(spark, sf_dir, "conversations")
    digests = conversation_digests(repair_conversations(damaged(turns))).withColumnRenamed("conv_id", "of_id")
    every = turns.select("conv_id").distinct().join(digests, F.col("conv_id").eqNullSafe(F.col("of_id")), "left").drop("of_id")
    zeros = dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0)
    return every.na.fill({**zeros, "audit": "", "repaired_sha256": sha256(b"").hexdigest()})


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of five lists that name hosts, domains and URLs of ``pages``."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))

    def entries(df: DataFrame, name: str, allow: bool, key: str, when: Column, at: Column, listed: bool) -> DataFrame:
        return df.where(when).select(
            F.lit(name).alias("list"), F.lit(allow).alias("allow"), F.col(key).alias("key"), day(at).alias("day"),
            F.lit(listed).alias("listed"),
        )

    n = F.col("n")
    hosts = pages.select("page_id", host_of("url").alias("host")).groupBy("host").agg(F.min("page_id").alias("n"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    domains = hosts.groupBy(domain.alias("domain")).agg(F.min("n").alias("n"))
    urls = pages.select("url", F.col("page_id").alias("n"))
    parts = [
        entries(hosts, "spam", False, "host", n % 3 == 0, n % 50, True),
        entries(hosts, "spam", False, "host", n % 3 == 0, n % 50 + 10, False),
        entries(hosts, "spam", False, "host", n % 6 == 0, n % 50 + 20, True),
        entries(domains, "adult", False, "domain", n % 4 == 1, n % 30, True),
        entries(hosts, "trusted", True, "host", n % 11 == 0, F.lit(5), True),
        entries(hosts, "trusted", True, "host", n % 11 == 0, F.lit(40), False),
        entries(urls, "phishing", False, "url", n % 13 == 0, n % 60, True),
        entries(urls, "phishing", False, "url", n % 26 == 0, n % 60 + 1, False),
        entries(urls, "stale", False, "url", n % 17 == 0, n % 60 + 1, True),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on one of sixty days, against five lists as they stood on that day."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")))
    judged = filter_captures(fetched, list_entries(pages), "page_id")
    return judged.withColumn("lists", F.array_join("lists", ","))


@query
def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response and a later or earlier revisit for every page, the revisits resolved."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("digest"))
    n = F.col("page_id")
    hour = lambda h: F.timestamp_seconds(F.lit(1_704_067_200) + h * 3600)
    fields = lambda *pairs: F.map_from_arrays(F.array(*map(F.lit, pairs[::2])), F.array(*pairs[1::2]))
    responses = pages.select(
        (n * 2).alias("record_id"), "url", hour(n * 37 % 500).alias("fetched"), F.lit("response").alias("kind"),
        F.when(n % 10 == 9, 404).otherwise(200).alias("status"),
        fields("ETag", F.substring("digest", 1, 8), "Content-Type", F.lit("text/html"), "Cache-Control", F.lit("max-age=60"))
        .alias("headers"), F.col("digest").alias("payload_digest"),
    )
    revisits = pages.select(
        (n * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"),
        hour(n * 37 % 500 + n % 5 - 1).alias("fetched"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        fields(
            "etag", F.when(n % 7 == 0, "other").otherwise(F.concat(F.lit("W/"), F.substring("digest", 1, 8))),
            "content-type", F.lit("text/plain"), "cache-control", F.concat(F.lit("max-age="), n.cast("string")),
        ).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    resolved = resolve_revisits(responses.unionByName(revisits))
    return resolved.select(
        "record_id", "url", "outcome", "refers_to", "payload_digest",
        *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("etag", "content-type", "cache-control")],
    )
