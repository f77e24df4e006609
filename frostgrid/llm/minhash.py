"""Documents whose sets of word shingles are alike, by SimHash fingerprints, MinHash bands and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostgrid.llm.common import checkpointed, enough_tasks, give_back, join_classes, join_lookup
from frostgrid.llm.components import components
from frostgrid.llm.simhash import majority, near_links

SEED = 42
# A pair of similarity 0.8 shares a band with a probability of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS = 20
ROWS = 5
# Members of a slice of a bucket, or of the list of a shingle.
SLICE_ROWS = 64
# A bucket of up to so many members has every two of them compared.
FEW_ROWS = 4
# Shingles of more crowded documents than this are counted one by one and come last in the order of rarity.
RARE_ROWS = 16
CACHE_BYTES = 1 << 26
# Words of 64 bits in the sketch of a set.
SKETCH_WORDS = 8
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS = 2 * _FACTORS + np.uint64(1)
_WORD_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text; a shorter text is one shingle, one without words has none.

    Words are hashed one by one, and the hashes of a shingle's words mixed in their order.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    of_words = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    length = min(words_per_shingle, len(words))
    n = len(words) - length + 1
    mixed = np.full(n, SEED + length, np.uint64)
    for at in range(length):
        mixed = (mixed ^ of_words[at:at + n]) * _WORD_FACTOR
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One number per band, made of the least of the hashes under each of its permutations."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at:at + 512, None] * _FACTORS + _TERMS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint_key(fp: int) -> int:
    """The bucket of a fingerprint, beside those of the bands."""
    return int(np.uint64(xxhash.xxh64_intdigest(fp.to_bytes(8, "little"), BANDS)).astype(np.int64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 ``SKETCH_WORDS`` bits whether an odd number of the hashes falls on it.

    A member in one of two sets only turns one bit, so the sketches of two sets
    never differ in more bits than the sets in members.
    """
    places = (hashes >> np.uint64(8)).astype(np.int64) % (64 * SKETCH_WORDS)
    odd = np.bincount(places, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Common members of two sets as a share of all their members; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _bytes(x: pa.Scalar) -> bytes | None:
    return x.as_buffer().to_pybytes() if x.is_valid else None


class _Sets:
    """The shingles of the texts that a task saw last, by the class they stand for."""

    def __init__(self, shingle: int):
        self.shingle, self.known, self.bytes = shingle, {}, 0

    def of(self, key: int, text: pa.Scalar) -> np.ndarray:
        found = self.known.get(key)
        if found is None:
            if self.bytes > CACHE_BYTES:
                self.known, self.bytes = {}, 0
            found = self.known[key] = shingles(_bytes(text), self.shingle)
            self.bytes += found.nbytes + 100
        return found


def _confirmed(pairs: DataFrame, whole: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` of classes whose texts in ``whole`` are alike."""
    left = whole.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = whole.select(F.col("key").alias("b"), F.col("text").alias("text_b"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(shingle)
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))
            alike = [similarity(sets.of(a, x), sets.of(b, y)) >= least for a, b, x, y in rows]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(alike, pa.bool_()))
        del sets
        give_back()

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(confirm, "a bigint, b bigint")


def _sliced(members: DataFrame, group: str, *carried: str) -> DataFrame:
    """Members (``key``) of groups cut into slices of about ``SLICE_ROWS``, so that no task holds a group.

    ``members`` has the rows ``n`` of its group. Keys are hashes, and a slice holds a range of them, so that
    neighbours are mostly the same in all groups that two members share. One row per slice:
    ``group``, ``n``, ``slice`` and ``keys``, the members in order, as structs with the carried columns.
    """
    slices = F.ceil(F.col("n") / SLICE_ROWS)
    place = (F.col("key") / F.lit(2.0**64) + 0.5) * slices
    numbered = members.withColumn("slice", F.least(F.floor(place), slices - 1).cast("int"))
    # Dealt out anew, so that a join before this may split a crowded group.
    dealt = numbered.repartition(group, "slice")
    listed = F.sort_array(F.collect_list(F.struct("key", *carried))).alias("keys")
    return dealt.groupBy(group, "slice").agg(F.max("n").alias("n"), F.max("least").alias("least"), listed)


# The members of a slice that stand after its member ``x``, which is at ``i``.
_AFTER = "slice(keys, i + 2, size(keys))"


def _apart(slices: DataFrame, others: str, apart: str) -> DataFrame:
    """Pairs ``a``, ``b`` of a member ``x`` of ``keys`` and one ``y`` of ``others`` for which the condition ``apart`` holds.

    Only pairs that meet the condition become rows, beside one for each slice without any.
    """
    of_one = f"transform(filter({others}, y -> {apart}), y -> named_struct('a', x.key, 'b', y.key))"
    # With a plain explode Spark would first ask whether there are pairs, and so compare all twice.
    met = F.explode_outer(F.expr(f"flatten(transform(keys, (x, i) -> {of_one}))"))
    return slices.select(met.alias("pair")).where("pair is not null").select("pair.a", "pair.b")


def rare_pairs(crowd: DataFrame, whole: DataFrame, shingle: int, least: float) -> DataFrame:
    """All pairs ``a``, ``b`` of classes of ``crowd`` (``key``, ``comp``) that may be alike to ``least``, in different components.

    The members of every set stand in one order, the rare ones first. Two sets
    alike to ``least`` overlap in at least ``least / (1 + least)`` of their sizes' sum, so the first
    member they share stands early: in the larger set before all but ``least`` of it,
    in the smaller before all but ``2 * least / (1 + least)``, and in both with enough after it.
    Pairs that share such a member are the candidates, whatever the order; as rare
    shingles come first, what many documents share makes no pairs of them. The
    lists of shingles that crowd even so are cut into slices, and slice is compared with slice.
    """

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(_bytes(x), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                 pa.array([parity_sketch(x) for x in sets], pa.list_(pa.int64()))], ["key", "shingles", "sketch"],
            )
        give_back()

    texts = whole.join(crowd.select("key"), "key").select("key", "text")
    spelled = checkpointed(texts.mapInArrow(spelt, "key bigint, shingles array<bigint>, sketch array<bigint>"))
    parts = enough_tasks(spelled.agg(F.sum(F.size("shingles"))).collect()[0][0])
    spelled = spelled.coalesce(parts)
    postings = spelled.select("key", F.explode("shingles").alias("shingle"))
    common = postings.groupBy("shingle").agg(F.count("*").alias("rows")).where(F.col("rows") > RARE_ROWS)
    # Read for their size too.
    common = checkpointed(common.coalesce(parts))
    counted = join_lookup(postings, common, "shingle", F.col("key")).coalesce(parts)
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "shingle"))).alias("order")
    early = lambda part: f"size(order) - cast(ceil({part} * size(order) - 1e-6) as int)"
    firsts = F.posexplode(F.expr(f"slice(order, 1, {early(least)} + 1)")).alias("at", "first")
    ordered = counted.groupBy("key").agg(order).withColumn("early", F.expr(early(2 * least / (1 + least))))
    leading = ordered.select("key", F.size("order").alias("size"), "early", firsts).select(
        "key", "size", "at", (F.col("at") <= F.col("early")).alias("early"), F.col("first.shingle").alias("shingle")
    ).join(crowd, "key")
    leading = checkpointed(leading.coalesce(parts))
    lists = leading.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("key").alias("least"), F.min("comp").alias("c"), F.max("comp").alias("d"),
        F.bool_or("early").alias("some"),
    ).where("n > 1 and c < d and some").drop("c", "d", "some")
    listed = join_classes(leading, lists, "shingle", F.col("key"), "inner").coalesce(parts)
    listed = listed.join(spelled.select("key", "sketch"), "key").coalesce(parts)
    slices = checkpointed(_sliced(listed, "shingle", "size", "at", "early", "comp", "sketch").coalesce(parts))
    differing = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_WORDS))
    alike = f"""
        x.comp <> y.comp and least(x.size, y.size) >= {least} * greatest(x.size, y.size) - 1e-6
        and if(x.size > y.size, y.early, x.early or (x.size = y.size and y.early))
        and least(x.size - x.at, y.size - y.at) >= {least / (1 + least)} * (x.size + y.size) - 1e-6
        and {differing} <= {(1 - least) / (1 + least)} * (x.size + y.size) + 1e-6
    """
    inside = _apart(slices, _AFTER, alike)
    # Each two slices of one list meet once.
    last = F.ceil(F.col("n") / SLICE_ROWS).cast("int") - 1
    left = slices.where(F.col("n") > SLICE_ROWS).withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("other > slice")
    right = slices.select("shingle", F.col("slice").alias("other"), F.col("keys").alias("others"))
    return inside.unionByName(_apart(left.join(right, ["shingle", "other"]), "others", alike))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, reach: int = 4
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash`` (xxhash64), ``root`` and ``component_id``.

    Documents whose sets of ``shingle`` words are alike to ``least`` or more are
    linked (common shingles as a share of all of either); ``component_id`` is
    the smallest ``doc_id`` that links lead to, ``root`` a number of the component
    that holds where ids repeat. Words are what white space of
    ASCII parts, with A-Z in lower case. Texts without words are alike. Ids that
    are null never become a component's id. Repeated rows stay.

    Documents with one set of shingles form a class, looked at once. Classes whose SimHash
    fingerprints are linked by the vantage-point tree of :func:`near_links` are compared. As
    sets that are 0.8 alike differ in some 9 bits, where no tree prunes, classes also
    meet in the buckets of 20 MinHash bands, and of one fingerprint. Each pair is confirmed on the
    whole texts of one document of either, so no link is wrong; a pair at 0.8
    meets with a probability of 0.9996, one more alike with a higher one.

    A first pass looks at the tree's links and at neighbours in each bucket only, about one pair for each member,
    which is enough where copies crowd. In a second pass every other
    two members of a bucket are compared, unless the first has put them in one component;
    where more than ``FEW_ROWS`` meet, by :func:`rare_pairs`, which misses none.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
        F.xxhash64(F.col(text_col).cast("binary")).alias("text_hash"),
    )

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, fps = [], [], []
            for x in batch.column(1):
                hashes = shingles(_bytes(x), shingle)
                keys.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                fps.append(majority(hashes))
                bands.append([*band_keys(hashes), fingerprint_key(fps[-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(keys, np.uint64).view(np.int64)),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", "text_hash", "key", "bands", "fp"],
            )
        give_back()

    of_docs = checkpointed(
        texts.mapInArrow(described, "doc_id bigint, text_hash bigint, key bigint, bands array<bigint>, fp bigint")
    )
    # Members of buckets are the most rows that a step reads.
    parts = enough_tasks((BANDS + 1) * of_docs.count())
    of_docs = of_docs.coalesce(parts)

    def kept(df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(parts))

    # All rows of a class have the same bands and fingerprint.
    classes = kept(
        of_docs.groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"),
            F.any_value("bands").alias("bands"), F.any_value("fp").alias("fp"), F.count("*").alias("n"),
        )
    )
    members = classes.select("key", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    dealt = kept(join_classes(members, shared, "band", F.col("key"), "inner"))
    slices = _sliced(dealt, "band").coalesce(parts)
    following = F.expr("transform(slice(keys, 2, size(keys)), (y, i) -> struct(keys[i].key as a, y.key as b))")
    chained = slices.select(F.explode(following).alias("pair")).select("pair.a", "pair.b")
    to_least = slices.select(F.col("least").alias("a"), F.expr("keys[0].key").alias("b")).where("a <> b")
    # Classes of one fingerprint share a bucket, so one stands for all of them.
    of_fp = kept(classes.groupBy("fp").agg(F.min("key").alias("key")))
    ends = [of_fp.select(F.col("fp").alias(f"fp_{x}"), F.col("key").alias(x)) for x in ("a", "b")]
    near = near_links(of_fp.select("fp"), reach).toDF("fp_a", "fp_b").coalesce(parts)
    near = near.join(ends[0], "fp_a").coalesce(parts).join(ends[1], "fp_b").select("a", "b").coalesce(parts)
    pairs = kept(chained.unionByName(to_least).unionByName(near).distinct())

    seen = dealt.select("key").union(pairs.select("a")).union(pairs.select("b"))
    wanted = seen.distinct().join(classes.select("key", "text_hash"), "key").coalesce(parts)
    # Copies of a text are one before they are dealt out.
    once = texts.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    whole = checkpointed(wanted.join(once, "text_hash").select("key", "text"))
    first = kept(components(_confirmed(pairs, whole, shingle, least)))

    comp = first.select(F.col("node").alias("key"), F.col("root").alias("comp"))
    placed = kept(dealt.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    mixed = placed.groupBy("band").agg(
        F.count("*").alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d")
    ).where("n > 2 and c < d").drop("c", "d")
    open_buckets = kept(join_classes(placed.drop("n"), mixed, "band", F.col("key"), "inner"))
    few = _sliced(open_buckets.where(F.col("n") <= FEW_ROWS), "band", "comp").coalesce(parts)
    crowd = kept(open_buckets.where(F.col("n") > FEW_ROWS).select("key", "comp").distinct())
    more = _apart(few, _AFTER, "x.comp <> y.comp")
    if not crowd.isEmpty():
        more = more.unionByName(rare_pairs(crowd, whole, shingle, least))
    left = kept(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = left.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti").coalesce(parts)
    forest = first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(forest.unionByName(_confirmed(left, whole, shingle, least)))

    known = kept(found.join(classes.select(F.col("key").alias("node"), "first_id"), "node"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("smallest"))
    moved = join_lookup(known, smallest, "root", F.col("node")).select(F.col("node").alias("key"), "root", "smallest")
    ids = kept(classes.select("key", "first_id", "n").join(moved, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), F.coalesce("smallest", "first_id").alias("component_id"), "n"
    ))
    joined = join_classes(of_docs.drop("bands", "fp"), ids, "key", F.struct("doc_id", "text_hash"), "inner")
    return joined.select("doc_id", "text_hash", "root", "component_id").coalesce(parts)
