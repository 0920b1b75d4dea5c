"""Benchmark decontamination by SimHash of item-sized windows.

A document can hold an item only where both share a shingle of five words. Each such place
gives the window that is as long as the item and aligned with it; runs of shared shingles
give their window once, and the window's words are cut out on the spot, so that texts are
neither shuffled nor read again. Windows and items of one length meet in a multi-index: 64
fingerprint bits are cut into ``RADIUS + 1`` blocks, and two fingerprints that differ in at
most ``RADIUS`` bits agree in a block at least. Distances of windows at the threshold scatter
beyond any useful radius, so the fingerprint rules nothing out alone: a window farther off meets
the items whose shingles gave it, and goes on unless too many of their shingles are missing from
it, which loses no pair. Candidates are then compared exactly, by the weighted Jaccard
similarity of their shingles, weights being how often a shingle occurs.

Benchmark shingles are broadcast in slices of a bounded number; a larger benchmark takes
more slices, each a scan of the documents. Windows, not documents, are what is shuffled.

Words are runs of letters and digits, lower-cased. An item of fewer than five words is one
shingle of all its words. Defined cases: null, blank and signs-only texts and items hold no
words and match nothing; a window that would pass an end of the text is moved inwards;
repeated documents give the same matches once per document id; repeated items match each.
Items have at most two million words. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting, unused

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS = 64, 11
#: Rows of the benchmark's shingles that are broadcast at once.
MOST_BROADCAST = 1_000_000
#: In place of a block's number where a window asks for an item by its id.
OWN = -1

GAPS = r"[^\p{L}\p{N}]+"
#: Three bits of a number spread to three lanes of 21 bits, in which they can be summed.
LANES, LANE_STEP, LANE_BITS = 3, 1 + (1 << 20) + (1 << 40), 21
LANE_MASK = 1 + (1 << 21) + (1 << 42)


def raw_words(text: Column) -> Column:
    """Words of a text; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS)


def _filled(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def _hash_at(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def _lane_sum(first: int):
    """Adds three bits of a hash, from bit ``first``, to their lanes."""

    def add(sums: Column, h: Column) -> Column:
        three = F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << LANES) - 1))
        return sums + (three * F.lit(LANE_STEP)).bitwiseAND(F.lit(LANE_MASK))

    return add


def fingerprint(words: Column) -> Column:
    """64-bit SimHash of words: each bit is that of most word hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    half = F.size(words)
    bits = []
    for group in range(-(-BITS // LANES)):
        sums = F.aggregate(hashes, F.lit(0).cast("long"), _lane_sum(group * LANES))
        for lane in range(LANES):
            at = group * LANES + lane
            if at < BITS:
                count = F.shiftrightunsigned(sums, lane * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
                bits.append(F.when(count * 2 > half, F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def block_spans() -> list[tuple[int, int]]:
    """(first bit, bits) of RADIUS + 1 blocks of nearly equal width."""
    n = RADIUS + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block(value: Column, span: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(value, span[0]).bitwiseAND(F.lit((1 << span[1]) - 1))


def _blocks(value: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(value, s).alias("bits")) for i, s in enumerate(block_spans())])


def shingles(words: Column) -> Column:
    """Shingles of an array of words; fewer words than a shingle are one."""
    last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays, weights being counts."""

    def count(x: Column, of: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(x, a), count(x, b)))
    return shared / (F.size(a) + F.size(b) - shared)


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, words, shingles, print) of items that hold words; bounded, so it is kept."""
    held = benchmark.select("item_id", _filled(raw_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    sized = held.withColumn("length", F.size("words"))
    return lasting(sized.withColumns({"shingles": shingles(F.col("words")), "print": fingerprint(F.col("words"))}))


def _anchors(known: DataFrame, n: int) -> DataFrame:
    """(item, hash, length, at, before): where shingles of ``n`` words stand in items of which length; ``item`` is a hash of the id."""
    rows = known.where(F.least("length", F.lit(SHINGLE)) == n).select(
        F.xxhash64("item_id").alias("item"), "length", "words", F.explode(F.sequence(F.lit(0), F.col("length") - n)).alias("at")
    )
    before = F.when(F.col("at") > 0, _hash_at("words", F.col("at") - 1, n))
    return rows.select("item", _hash_at("words", F.col("at"), n).alias("hash"), "length", "at", before.alias("before")).distinct()


def windows(docs: DataFrame, known: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, key, items, start, length, words) of item-sized windows that share a shingle with an item of that length.

    ``key`` is a hash of the whole text, ``items`` are hashes of the ids of the items that share it.
    """
    sizes = [r[0] for r in known.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]  # five at most
    found = []
    for n in sorted(sizes):
        anchors = lasting(_anchors(known, n))
        parts = max(1, -(-anchors.count() // most_broadcast))
        cut = docs.select("doc_id", F.md5("text").alias("key"), raw_words(F.col("text")).alias("words"))
        places = cut.where(F.size("words") >= n).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("place"))
        hashed = places.withColumn("hash", _hash_at("words", F.col("place"), n))
        for part in range(parts):
            own = anchors.where(F.pmod(F.xxhash64("hash", "item"), F.lit(parts)) == part)
            own = own.groupBy("hash", "length", "at", "before").agg(F.collect_set("item").alias("items"))  # within the slice's rows
            hits = hashed.join(F.broadcast(own), "hash")
            fresh = (F.col("place") == 0) | F.col("before").isNull() | (_hash_at("words", F.col("place") - 1, n) != F.col("before"))
            start = F.greatest(F.least(F.col("place") - F.col("at"), F.size("words") - F.col("length")), F.lit(0))
            found.append(
                hits.where(fresh)
                .withColumn("start", start)
                .select("doc_id", "key", "items", "start", "length", _filled(F.slice("words", F.col("start") + 1, F.col("length"))).alias("words"))
            )
    if not found:
        return docs.where("false").select(
            "doc_id", F.lit("").alias("key"), F.array(F.lit(0).cast("long")).alias("items"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.array(F.lit("")).alias("words")
        )
    return reduce(DataFrame.unionByName, found)


def candidates(found: DataFrame, known: DataFrame, radius: int = RADIUS, own: Column | None = None, least: float = SIMILARITY) -> DataFrame:
    """Windows with the items of their length whose fingerprints differ in at most ``radius`` bits.

    ``own`` are hashes of ids of items that a window meets at any distance, unless so many of
    their shingles are missing from it that it cannot be ``least`` similar. Each pair is met once.
    """
    printed = found.withColumn("window_print", fingerprint(F.col("words")))
    asks = _blocks(F.col("window_print"))
    if own is not None:
        asks = F.concat(asks, F.transform(own, lambda i: F.struct(F.lit(OWN).alias("block"), i.alias("bits"))))
    asked = printed.select("*", F.explode(asks).alias("b")).select("*", "b.*").drop("b")
    own_key = F.array(F.struct(F.lit(OWN).alias("block"), F.xxhash64("item_id").alias("bits")))
    index = known.select(
        "item_id", "length", "print", F.col("shingles").alias("item_shingles"), F.explode(F.concat(_blocks(F.col("print")), own_key)).alias("b")
    ).select("*", "b.*").drop("b")
    differ = F.col("window_print").bitwiseXOR(F.col("print"))
    first = reduce(
        lambda later, i: F.when(_block(differ, block_spans()[i]) == 0, F.lit(i)).otherwise(later), range(RADIUS, -1, -1), F.lit(OWN)
    )
    met = asked.join(index, ["length", "block", "bits"])
    near = F.bit_count(differ) <= radius
    return met.where(F.when(F.col("block") == OWN, ~near & _may_be_alike(F.col("item_shingles"), shingles(F.col("words")), least)).otherwise((F.col("block") == first) & near))


def _may_be_alike(a: Column, b: Column, least: float) -> Column:
    """False only where the shingles of ``a`` that ``b`` lacks rule a similarity of ``least`` out."""
    shared = F.size(a) - F.size(F.array_except(a, b))  # no more than this
    return shared >= least / (1 + least) * (F.size(a) + F.size(b)) - 1e-6


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, key, item_id, start, length, similarity): the best window per document and item."""
    known = items(benchmark)
    near = candidates(windows(docs, known, most_broadcast), known, own=F.col("items"), least=least)
    alike = near.withColumn("similarity", F.round(similarity(F.col("item_shingles"), shingles(F.col("words"))), 9)).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("best")
    return (
        alike.groupBy("doc_id", "key", "item_id")
        .agg(best)
        .select("doc_id", "key", "item_id", (-F.col("best.back")).alias("start"), "best.length", "best.similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item, whole; equal texts share their fate."""
    key = unused(docs, "_key")
    held = leaks(docs, benchmark, least).select(F.col("key").alias(key)).distinct()
    return docs.join(held, F.md5("text") == F.col(key), "left_anti")
