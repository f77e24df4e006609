"""From raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, fresh_names, join_classes, written
from frostgrid.llm.language import fit_text_model, fused
from frostgrid.llm.minhash import similar_groups
from frostgrid.llm.mixing import mix_sources
from frostgrid.llm.packing import pack_sequences, token_pieces
from frostgrid.llm.queries import SOURCE_WEIGHTS, word_tokenizer
from frostgrid.llm.repeats import remove_repeats
from frostgrid.sources import read_table

# Stages identify languages by a trained model, encode by a tokenizer file and
# link documents without bound, none of which SQL can express.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, with the language found as their ``lang``; noise goes.

    A text without words is in the language its declaration and source speak
    for. An empty table stays empty.
    """
    found = fused(docs, fit_text_model(docs)).where("__accepted")
    return found.withColumn("lang", F.col("__language")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest ``doc_id``.

    Near duplicates share four fifths or more of their shingles of five words. They
    are found by their SimHash fingerprints, and by MinHash bands where these are
    too far apart, and confirmed on their texts.
    Rows are told apart by id and text. Of several texts with this id the one
    with the least hash stays, and of rows that repeat id and text the least as
    JSON. Rows of one id whose texts are not alike are judged
    apart. Rows without an id stay, unless they are linked to a document with one.
    """
    groups = checkpointed(similar_groups(docs))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    of_root = groups.groupBy("root").agg(F.min(named).alias("kept"), F.count("*").alias("n")).where("n > 1")
    judged = join_classes(groups, of_root, "root", F.struct("doc_id", "text_hash"), "inner")
    gone = F.coalesce(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("kept")) & F.col("kept").isNotNull(), F.lit(False))
    # Rows of one id and text share a decision; all others stay as they are.
    of_id, of_text, dropped, copies = fresh_names(docs, "of_id", "of_text", "dropped", "copies")
    marks = checkpointed(judged.groupBy(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text)).agg(
        F.bool_or(gone).alias(dropped), F.count("*").alias(copies)
    ).where(F.col(dropped) | (F.col(copies) > 1)))
    same = (F.xxhash64(F.col("text").cast("binary")) == F.col(of_text)) & F.col("doc_id").eqNullSafe(F.col(of_id))
    left = docs.join(marks, same, "left").where(~F.coalesce(dropped, F.lit(False)))
    if marks.where((F.col(copies) > 1) & F.col(of_id).isNotNull()).isEmpty():
        # The texts are dealt out once only.
        return left.select(*docs.columns)
    repeated = (F.col(copies) > 1) & F.col("doc_id").isNotNull()
    once = left.where(~F.coalesce(repeated, F.lit(False))).select(*docs.columns)
    row = F.struct(*docs.columns)
    one = left.where(repeated).groupBy(of_id, of_text).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(one.select("row.*"))


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes or more that an earlier document has too.

    Parts of characters left at a cut go as well. A document of which nothing
    is left goes; one that had no text to begin with stays.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    marked = docs.withColumn("__null", F.col("text").isNull())
    left = remove_repeats(marked, keep=("__null", *others), as_text=True)
    changed = F.size("spans") > 0
    result = left.where(~changed | (F.col("kept") != "")).withColumn("text", F.when(~F.col("__null"), F.col("kept")))
    if "n_chars" in others:
        result = result.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
    return result.select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: not at all, once or twice.

    A document of which the mix takes, say, 1.3 times its words comes once, and
    twice if a hash of its id is in the lower three tenths, so the words of a
    source come near its target without cutting documents. Rows of one id share
    their words. A document without words is taken once.
    """
    taken = mix_sources(docs, SOURCE_WEIGHTS)
    per_doc = taken.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    steps = 1 << 20
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(steps)) / steps
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + chance).cast("int"))
    of_id, repeats, copy = fresh_names(docs, "of_id", "repeats", "copy")
    per_id = per_doc.select(F.col("doc_id").alias(of_id), times.alias(repeats)).where(F.col(repeats) > 0)
    joined = docs.join(per_id, F.col("doc_id").eqNullSafe(F.col(of_id)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(repeats)))).select(*docs.columns)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_sequences(token_pieces(docs, word_tokenizer()))


STAGES = [
    ("language identification", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", remove_repeated_strings),
    ("mixing", mix_to_weights),
    ("packing", pack_best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{place}")
    return docs
