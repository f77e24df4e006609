"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, join_lookup, tasks

WORD = r"[^\x20\x09-\x0D]+"
# Cells that a source is laid out in, a prime, so that ids at regular steps spread over all of them.
CELLS = 4093
BLOCK_WORDS = 32
SHARD_SLOTS = 8192
ROUNDS = 12
MULTIPLIER = 1_000_003
# Steps of the numbers that slots draw their shards by: a factor and a term each, modulo 2 ** 31.
DRAWS = [(1_103_515_245, 12_345), (69_069, 362_437), (1_664_525, 101_390_423)]
MODULUS = 1 << 31


def words(text: str | Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: list[float], factor: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Words to take of every source.

    ``sizes`` has ``source`` and ``source_size``, one row a source. Sources in the
    order of their code points, null last, weigh ``weights``, repeated. They share
    ``factor`` times all words by weight; a target stops at ``most`` times its
    source's size, and what is over is shared again by weight until no target is
    above. Adds ``rank`` (from 0) and ``target``.

    Filled like connected vessels: sources by cap per weight, each full one
    leaving the rest to those after it. One row per source goes through windows
    without a key, and never a row per document.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("bigint")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(
        by_level.rowsBetween(0, Window.unboundedFollowing)
    )
    ranked = (
        sizes.withColumn("rank", rank)
        .withColumns({"weight": weight, "cap": cap})
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(factor)))
        .withColumn("level", level)
        .withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    )
    last_level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * last_level["level"])
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def laid_out(sized: DataFrame) -> DataFrame:
    """Add ``start``: the words of the same source before each row.

    Rows of a source follow each other by ``doc_id % CELLS``, ``doc_id`` and
    ``size``. Each cell is summed by itself and starts where the totals of the
    cells before end, so a source is not sorted in one task.
    """
    placed = sized.withColumn("cell", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(CELLS)))
    totals = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(
        F.col("source").alias("cell_source"), F.col("cell").alias("cell_no"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"),
    )
    within = (
        Window.partitionBy("source", "cell").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("cell") == F.col("cell_no"))
    return inside.join(begins, same).withColumn("start", F.col("begin") + F.col("inside")).drop(
        "cell", "cell_source", "cell_no", "begin", "inside"
    )


def permuted(df: DataFrame, index: str, n: str, key: str, name: str) -> DataFrame:
    """Add ``name``: a pseudorandom permutation of ``index`` in 0 .. ``n`` - 1, another for each ``key``.

    Swap-or-not rounds: an index and its mirror image about a key change places
    or stay, as a bit made from the larger of the two says.
    """
    turns = [F.lit(7_919 * (r + 1) ** 2) * (F.col(key) + 1) + F.lit(104_729 * r) for r in range(ROUNDS)]
    rounds = F.array(*[F.struct(F.pmod(t, F.col(n)).alias("turn"), F.lit(15_485_863 * (r + 1)).cast("bigint").alias("add"))
                       for r, t in enumerate(turns)])

    def swap_or_not(x: Column, of: Column) -> Column:
        mirror = F.pmod(of["turn"] - x, F.col(n))
        bit = F.shiftright(F.greatest(x, mirror) * MULTIPLIER + of["add"], 13) % 2
        return F.when(bit == 1, mirror).otherwise(x)

    return df.withColumn(name, F.aggregate(rounds, F.col(index), swap_or_not))


def drawn_shard(rank: Column, slot: Column, shards: Column) -> Column:
    """A pseudorandom shard for each slot of each source."""
    x = F.pmod(slot + (rank + 1) * MULTIPLIER, F.lit(MODULUS))
    for factor, term in DRAWS:
        x = F.pmod(x * factor + term, F.lit(MODULUS))
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return F.pmod(F.shiftright(x, 3), shards)


def draw_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as slots: ``shard``, ``rank`` of the source, ``slot`` and ``block``.

    A source fills a slot per block for each time its words fit into the target,
    and ``1 / block_words`` slots, rounded, for each word left, at most twice its
    blocks in all. Each slot draws its output shard, which makes the counts of a shard
    and source multinomial, conditioned on the totals, so that every source
    meets its target. A source's slots are then numbered shard by shard, and
    slot ``i`` takes block ``permutation(i mod blocks)``: all blocks are taken
    once before one is taken twice.
    """
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("bigint")
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - passes * F.col("source_size")) / F.lit(block_words)).cast("bigint")
    slots = F.least(passes * F.col("blocks") + rest, F.col("blocks") * 2)
    parts = tasks(sources.sparkSession)
    counted = sources.where("source_size > 0").select("rank", blocks.alias("blocks"), "target", "source_size")
    counted = counted.withColumn("slots", slots).where("slots > 0").drop("target", "source_size")
    shards = F.greatest(F.ceil(F.col("all_slots") / F.lit(shard_slots)), F.lit(1)).cast("bigint")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = counted.withColumn("all_slots", F.sum("slots").over(everything)).withColumn("shards", shards)

    draws = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / F.lit(shard_slots))))
    batches = counted.withColumn("batch", draws).repartition(parts, "rank", "batch")
    last = F.least((F.col("batch") + 1) * shard_slots, F.col("slots")) - 1
    drawn = batches.withColumn("i", F.explode(F.sequence(F.col("batch") * shard_slots, last)))
    shard = drawn_shard(F.col("rank"), F.col("i"), F.col("shards"))
    counts = drawn.groupBy("rank", "blocks", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))

    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # By its few bytes this would be merged into one task, but each row becomes a shard's slots.
    numbered = numbered.repartition(parts, "rank", "shard")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    filled = numbered.select("shard", "rank", "blocks", slot.alias("slot"))
    filled = filled.withColumn("index", F.col("slot") % F.col("blocks"))
    return permuted(filled, "index", "blocks", "rank", "block").select("shard", "rank", "slot", "block")


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    factor: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Words of each document that a mix of the sources takes.

    One row per document: ``doc_id``, ``source``, ``size`` (words; null text: 0),
    ``source_size``, ``target``, ``taken`` and ``shards``, an array of the output shards that take
    some of it, with the ``words`` of each, in order. The words of a source are laid end to end
    and cut into blocks of ``block_words``; the slots of :func:`draw_slots` take
    blocks by index, and a document is taken with each block it lies in. A
    source's total misses its target by at most one and a half blocks. Null is a source like any other.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    sized = checkpointed(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"),
            words(text_col).alias("size"),
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = checkpointed(source_targets(sizes, weights, factor, most))
    rows = checkpointed(join_lookup(laid_out(sized), sources, "source", F.col("doc_id")))

    times = draw_slots(sources, block_words).groupBy("rank", "block", "shard").agg(F.count(F.lit(1)).alias("times"))
    first = F.floor(F.col("start") / F.lit(block_words))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(block_words))
    pieces = rows.where("size > 0").select(
        F.col("rank").alias("of"), "start", "size", F.explode(F.sequence(first, last)).alias("at")
    )
    inside = F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * block_words) - F.greatest(
        F.col("start"), F.col("at") * block_words
    )
    # Both sides grow with the documents, so neither is to be broadcast, however few bytes it is shuffled in.
    joined = pieces.join(times.hint("merge"), (F.col("of") == F.col("rank")) & (F.col("at") == F.col("block")))
    per_shard = joined.groupBy(F.col("of").alias("__rank"), F.col("start").alias("__start"), "shard").agg(
        F.sum(inside * F.col("times")).alias("words")
    )
    # At most a shard for each slot of a document's blocks, so an array grows with its text only.
    taken = per_shard.groupBy("__rank", "__start").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards")
    )
    same = (F.col("rank") == F.col("__rank")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
    none = F.array().cast("array<struct<shard:bigint,words:bigint>>")
    return rows.join(taken.hint("merge"), same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("shards", none).alias("shards"),
    )
