"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share ``share`` times all words by weight; no target exceeds ``repeats``
times its source's words, and the excess is shared again among the others.

Schedule: slot ``n`` takes the point ``frac((n + 1) * golden ratio)``, which falls into one
source's stretch of the cumulative target shares; slots are ranked per source. A source's
documents are put into a shuffled order and cut into blocks of ``block`` words; its slot of
rank r takes block ``r mod blocks``, so that a source is gone through evenly before it
repeats. Every source takes part until its target is met to the word: points beyond that
are passed over, and the few slots that the sequence's discrepancy leaves out are added at
the end. The last slot of a source is cut to the words still wanted. ``sequence`` is the mix
itself, a row per slot and document with the words it takes there; what is taken of a
document, and where it first comes up, are sums over its rows.

Large sources: order, blocks and ranks are sums over hash buckets and slot ranges, so no
source meets in one task. There is one small row per slot, document and block.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source
(the last one); repeated rows are documents of their own; an empty table gives no rows. An
input column that has the name of a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglantern.llm.common import WORD, lasting, placed, unused

#: frac(golden ratio)
GOLDEN = 0.6180339887498949
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS, BLOCK = 1.5, 2, 256

#: Slots that are ranked together.
SLOT_RANGE = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """A slim row per document that later steps share; texts are read once, here."""
    size = word_count(F.col("text"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    told = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    order = F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", key.alias("key"), size.alias("size"), order.alias("order"), F.md5("text").alias("text_md5"))
    return lasting(slim)


def targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: its words, weight and target.

    Sharing the excess again and again ends where every source below its limit has the same
    target per weight; that level is found from sums over the sources in order of limit per
    weight. The table has a row per source, which is small.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = slim.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    weighed = sources.withColumn("rank", F.row_number().over(by_code_point) - 1).withColumn(
        "weight", F.get(cycle, F.pmod(F.col("rank"), F.lit(len(weights))))
    )
    limited = weighed.withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    wanted = share * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    levels = limited.withColumn("level", level)
    open_level = F.when(F.col("level") < F.col("limit") / F.col("weight"), F.col("level"))
    return (
        levels.withColumn("_level", open_level)
        .withColumn("_at", F.when(F.col("_level").isNotNull(), F.col("limit") / F.col("weight")))
        .withColumn("_found", F.min(F.when(F.col("_at").isNotNull(), F.struct("_at", "rank", "_level"))).over(everything)["_level"])
        .withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("_found") * F.col("weight"), F.col("limit"))))
        .select("key", "source", "rank", "weight", "source_size", "target")
    )


def quotas(shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds each source's blocks, slots and the words of its last slot."""
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    rest = F.col("words") - F.col("whole") * F.col("source_size")
    return (
        shares.withColumn("words", words)
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("whole", whole)
        .withColumn("rest", rest)
        .withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )


def schedule(plan: DataFrame) -> DataFrame:
    """Slots in order: (slot, key, turn), turn being the rank of the slot within its source."""
    spark = plan.sparkSession
    edges = plan.where("slots > 0").select(
        "key", "slots", F.sum("slots").over(Window.orderBy("rank")).alias("upto"), F.sum("slots").over(Window.partitionBy()).alias("all")
    )
    edges = edges.select("key", "slots", ((F.col("upto") - F.col("slots")) / F.col("all")).alias("low"), (F.col("upto") / F.col("all")).alias("high"), "all")
    total, sources = edges.agg(F.coalesce(F.max("all"), F.lit(0)), F.count("*")).first()
    bounds = edges.agg(F.sort_array(F.collect_list(F.struct("high", "key"))).alias("ends"))  # one small row per source
    point = (F.col("slot") + 1) * GOLDEN - F.floor((F.col("slot") + 1) * GOLDEN)
    last = F.size("ends") - 1

    def step(found, width):
        """Binary search: how many stretches end at or before the point; the last one takes the rest."""
        ends_before = F.get("ends", found + width - 1)["high"] <= point
        return F.when((found + width <= last) & ends_before, found + width).otherwise(found)

    found = F.aggregate(F.array(*[F.lit(1 << k) for k in range(sources.bit_length() - 1, -1, -1)]), F.lit(0), step) if sources else F.lit(0)
    drawn = (
        spark.range(total)
        .withColumnRenamed("id", "slot")
        .join(F.broadcast(bounds))
        .select("slot", F.get("ends", found)["key"].alias("key"))
        .withColumn("range", F.floor(F.col("slot") / SLOT_RANGE))
    )
    counts = drawn.groupBy("key", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "range").orderBy("slot")
    ranked = drawn.join(starts, ["key", "range"]).select("slot", "key", (F.col("start") + F.row_number().over(inside) - 1).alias("turn"))
    kept = ranked.join(F.broadcast(plan.select("key", "slots")), "key").where("turn < slots").select("slot", "key", "turn")
    drawn_sums = counts.groupBy("key").agg(F.sum("n").alias("n"))
    late = (
        plan.where("slots > 0")
        .join(drawn_sums, "key", "left")
        .where("slots > coalesce(n, 0)")
        .select("key", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("slots") - 1)).alias("turn"))
    )
    return kept.unionByName(late.select((F.lit(total) + F.col("turn")).alias("slot"), "key", "turn"))


def pieces(at: DataFrame, slots: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, row, first_word, words): which words of which document each slot takes.

    ``at`` has each document's position in its source's shuffled order. A block has at most
    ``block`` documents and few slots, so the join is even however large a source is.
    """
    facts = plan.select("key", "blocks", "slots", "rest")
    last = (F.col("turn") == F.col("slots") - 1) & (F.col("rest") % block != 0)
    asked = slots.join(F.broadcast(facts), "key").select(
        "slot", "key", F.pmod(F.col("turn"), F.col("blocks")).alias("number"), F.when(last, F.col("rest") % block).otherwise(block).alias("part")
    )
    first, past = F.floor(F.col("position") / block), F.floor((F.col("position") + F.col("size") - 1) / block)
    held = at.where("size > 0").select("row", "key", "position", "size", F.explode(F.sequence(first, past)).alias("number"))
    low = F.greatest(F.col("position"), F.col("number") * block)
    high = F.least(F.col("position") + F.col("size"), F.col("number") * block + F.col("part"))
    return (
        held.join(asked, ["key", "number"])
        .select("slot", "row", (low - F.col("position")).cast("long").alias("first_word"), (high - low).cast("long").alias("words"))
        .where("words > 0")
    )


def _placed(slim: DataFrame) -> DataFrame:
    return placed(slim, ["key"], ["order", "doc_id", "row"], F.col("size"))


def sequence(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK
) -> DataFrame:
    """The mix in order: (slot, place, doc_id, source, first_word, words), sorted by (slot, place) when read.

    ``place`` is the first word's position in its source's shuffled order; words of a document
    are counted from 0.
    """
    slim = sizes(docs)
    plan = lasting(quotas(targets(slim, weights, share, repeats), block))
    at = _placed(slim)
    told = at.select("row", "doc_id", "source", "position")
    return pieces(at, schedule(plan), plan, block).join(told, "row").select(
        "slot", (F.col("position") + F.col("first_word")).alias("place"), "doc_id", "source", "first_word", "words"
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int = BLOCK,
    keep: DataFrame | None = None,
) -> DataFrame:
    """Slim rows (row, doc_id, source, size, source_size, target, position, taken, first_slot) of a mix.

    ``position`` is the document's first word in its source's shuffled order, ``first_slot``
    the first slot that takes a word of it (null: none does). ``keep`` may hand in what
    ``sizes`` gave, so that the caller can join the texts back by ``row``.
    """
    taken = _taken(sizes(docs) if keep is None else keep, weights, share, repeats, block)
    return taken.select("row", "doc_id", "source", "size", "source_size", "target", "position", "taken", "first_slot")


def _taken(slim: DataFrame, weights: tuple[float, ...], share: float, repeats: int, block: int) -> DataFrame:
    """The slim rows with all their columns and what the mix takes of them."""
    plan = lasting(quotas(targets(slim, weights, share, repeats), block))
    # parts of the work end in tables of their own: a plan of all would be planned anew after each of its stages
    at, slots = lasting(_placed(slim)), lasting(schedule(plan))
    taken = pieces(at, slots, plan, block).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return (
        at.join(taken, "row", "left")
        .join(F.broadcast(plan.select("key", "source_size", "target")), "key")
        .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """The documents of a mix, whole, each as often as it is taken to the nearest whole number.

    Documents without words hold nothing to mix and are left out. Rows of equal id and text
    are taken equally often.
    """
    slim = sizes(docs).withColumn("same", _same(F.col("text_md5")))
    taken = _taken(slim, weights, share, repeats, block).where("size > 0")
    same, times, copy = (unused(docs, c) for c in ("_same", "_times", "_copy"))
    counts = F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times)
    copies = taken.groupBy(F.col("same").alias(same)).agg(counts)
    own = docs.withColumn(same, _same(F.md5("text"))).join(lasting(copies.where(F.col(times) > 0)), same)
    return own.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def _same(text_md5: Column) -> Column:
    """What rows of equal id, source and text share."""
    told = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_md5, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))]
    return F.md5(F.concat_ws(":", *told))
