"""Sharding by balanced label propagation.

Documents that share a group (equal texts, or any other links given as groups) should meet
in one shard. Linked documents start spread evenly. In each round a group's members are
counted per shard (so that no pair of documents is ever made) and the group votes with these
counts, ties going the same way for a whole group within a round; a document asks to move
where most votes of its groups point. A mover from a to b
is let through if another moves from b to a, or if b has room; per pair of shards the number
is a quota, and movers are taken in hash order. So no shard ever exceeds its share of the
rows. After the last round the members that quotas turned away are dealt, in one go, to the
room that is left: to their group's fullest shard, or, group by group, to the shards with
most room. Documents without links fill what is left, so that counts differ by one at most.

Ranks are taken from bucket sums, so no shard, pair or group meets in one task. A vote is one
row with a number per shard. Quotas are worked out in the driver from a count per pair of shards.

Defined cases: a null text has no size, no checksum and no links; empty texts are equal
texts; repeated rows are rows of their own; with fewer rows than shards some shards stay
empty; an empty table gives no rows. Other columns of the input are ignored by
``shard_texts`` and kept by ``shard_documents``, where equally named results replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting, placed, unused

SHARDS, ROUNDS = 24, 4


def documents(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A slim row per document: id, size, checksum, a hash to order by and the group of its text.

    ``row`` names a column that tells rows apart; rows are numbered if there is none.
    """
    text = F.col("text")
    slim = docs.select(
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group"),
    )
    return lasting(slim.withColumn("order", F.xxhash64("doc_id", "size", "text_crc32")))


def text_links(slim: DataFrame) -> DataFrame:
    """(row, group) of documents that share their text with another."""
    shared = slim.where("group is not null").groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return slim.join(shared, "group").select("row", "group")


def _wishes(state: DataFrame, shards: int) -> DataFrame:
    """The state with ``to``, where most members of a row's groups are; a group shares its ``seed`` for ties."""
    members = state.withColumn("group", F.explode_outer("groups"))
    inside = [F.sum((F.col("shard") == s).cast("long")) for s in range(shards)]
    spread = members.where("group is not null").groupBy("group").agg(F.array(*inside).alias("spread"))
    sums = [F.sum(F.get("spread", F.lit(s))) for s in range(shards)]
    voted = (
        members.join(spread, "group", "left")
        .groupBy("row", "order", "shard", "round")
        .agg(F.first("groups").alias("groups"), F.array(*sums).alias("votes"), F.max(F.xxhash64("group")).alias("seed"))
    )

    def label(n: Column, s: Column) -> Column:
        return F.struct(n.alias("n"), F.xxhash64("seed", s, "round").alias("tie"), s.alias("to"))

    to = F.when(F.size("groups") > 0, F.array_max(F.transform("votes", label))["to"]).otherwise(F.col("shard"))
    return voted.select("row", "order", "groups", "round", "shard", to.alias("to"))


def _quotas(asked: dict[tuple[int, int], int], loads: list[int], rows: int) -> dict[tuple[int, int], int]:
    """How many may move from a to b: as many as move back, and b's free rows by demand."""
    shards = len(loads)
    swaps = {(a, b): min(n, asked.get((b, a), 0)) for (a, b), n in asked.items()}
    quotas = {}
    for b in range(shards):
        free = rows // shards + (b < rows % shards) - loads[b]
        asking = [(a, asked[a, b] - swaps[a, b]) for a in range(shards) if (a, b) in asked]
        most, upto = max(sum(n for _, n in asking), free, 1), 0
        for a, n in asking:
            # of the free rows, those of the first that ask; none is lost to rounding
            quotas[a, b] = swaps[a, b] + free * (upto + n) // most - free * upto // most
            upto += n
    return quotas


def propagate(slim: DataFrame, links: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, order, shard) of linked documents after the last round; no shard exceeds its share of ``rows``.

    A row carries its groups along. What moves per pair of shards is counted and allotted in the
    driver, which holds a number per pair; rows that stay are not shuffled again.
    """
    linked = links.groupBy("row").agg(F.collect_list("group").alias("groups")).join(slim.select("row", "order"), "row")
    even = placed(linked.withColumn("all", F.lit(0)), ["all"], ["order", "row"])
    # the number of the round is a column: rounds share their plans' code
    at = F.pmod("position", F.lit(shards)).cast("int").alias("shard")
    state = lasting(even.select("row", "order", "groups", F.lit(0).alias("round"), at))
    found = _loads(state)
    loads = [found.get(s, 0) for s in range(shards)]
    for _ in range(rounds):
        wishes = lasting(_wishes(state, shards))
        moving = wishes.where("shard != to")
        asked = {(r["shard"], r["to"]): r["n"] for r in moving.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # a row per pair of shards
        quotas = _quotas(asked, loads, rows)
        for (a, b), n in quotas.items():
            loads[a], loads[b] = loads[a] - n, loads[b] + n
        allowed = F.expr(f"array({', '.join(f'{quotas.get((a, b), 0)}L' for a in range(shards) for b in range(shards))})")
        ranked = placed(moving, ["shard", "to"], ["order", "row"], buckets=64)
        after = F.when(F.col("position") < F.get(allowed, F.col("shard") * shards + F.col("to")), F.col("to")).otherwise(F.col("shard"))
        moved = ranked.select("row", "order", "groups", "round", after.alias("shard"))
        stayed = wishes.where("shard = to").drop("to")
        state = lasting(stayed.unionByName(moved).withColumn("round", F.col("round") + 1))
    return state.select("row", "order", "shard")


def gather(state: DataFrame, links: DataFrame, rows: int, shards: int = SHARDS) -> DataFrame:
    """The state with the members that quotas turned away dealt to the room that is left, in one go.

    A document counts for the largest of its groups. Members away from their group's fullest
    shard line up for it, group by group; those beyond its room line up, group by group, for the
    room of all shards, the largest first; what those away leave behind is room as well. Places in both lines are sums over groups, and
    places within a group sums over its parts, so that a group may be of any size.
    """
    sizes = links.groupBy("group").agg(F.count("*").alias("n"))
    own = links.join(sizes, "group").groupBy("row").agg(F.max(F.struct("n", "group"))["group"].alias("group"))
    owned = lasting(state.join(own, "row"))
    inside = [F.sum((F.col("shard") == s).cast("long")) for s in range(shards)]
    spread = owned.groupBy("group").agg(F.array(*inside).alias("spread"))
    fullest = F.array_max(F.transform("spread", lambda n, s: F.struct(n.alias("n"), F.xxhash64("group", s).alias("tie"), s.alias("home"))))
    away = F.aggregate("spread", F.lit(0).cast("long"), lambda total, n: total + n) - F.col("fullest.n")
    groups = spread.withColumn("fullest", fullest).select(
        "group", "spread", F.col("fullest.home").alias("home"), away.alias("away"), F.xxhash64("group").alias("order")
    )
    moving = lasting(groups.where("away > 0"))
    loads = _loads(state)
    freed = moving.agg(*[F.sum(F.when(F.col("home") == s, 0).otherwise(F.get("spread", F.lit(s)))).alias(f"s{s}") for s in range(shards)]).first()
    # all that are away are dealt anew, so the room they leave is room as well
    rooms = [rows // shards + (s < rows % shards) - loads.get(s, 0) + (freed[s] or 0) for s in range(shards)]
    lined = placed(moving.drop("spread"), ["home"], ["order", "group"], size=F.col("away"), buckets=64, name="start")
    room = F.get(F.array(*[F.lit(r).cast("long") for r in rooms]), F.col("home"))
    settled = lasting(lined.withColumn("granted", F.greatest(F.lit(0).cast("long"), F.least("away", room - F.col("start")))))
    taken = {r["home"]: r["n"] for r in settled.groupBy("home").agg(F.sum("granted").alias("n")).collect()}  # a row per shard
    left = sorted(((rooms[s] - taken.get(s, 0), s) for s in range(shards)), reverse=True)
    beyond = settled.withColumns({"all": F.lit(0), "beyond": F.col("away") - F.col("granted")})
    queued = placed(beyond, ["all"], ["order", "group"], size=F.col("beyond"), name="queue").select("group", "home", "granted", "queue")
    movers = placed(owned.join(queued, "group").where("shard != home"), ["group"], ["order", "row"], buckets=64, name="nth")
    spot = F.col("queue") + F.col("nth") - F.col("granted")
    to, upto = F.lit(None).cast("int"), sum(n for n, _ in left)
    for n, s in reversed(left):
        to = F.when(spot < upto, F.lit(s)).otherwise(to)
        upto -= n
    found = movers.select("row", F.when(F.col("nth") < F.col("granted"), F.col("home")).otherwise(to).alias("to"))
    return lasting(state.join(found, "row", "left").select("row", "order", F.coalesce("to", "shard").alias("shard")))


def _loads(state: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard


def shard(slim: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The slim rows with ``shard`` and ``slot``; ``links`` has (row, group)."""
    total = slim.count()
    state = gather(propagate(slim, links, total, shards, rounds), links, total, shards)
    loads = _loads(state)
    # each of the two is read twice by what follows
    met = lasting(slim.join(state.select("row", "shard"), "row", "left"))
    alone = placed(met.where("shard is null").withColumn("all", F.lit(0)), ["all"], ["order", "row"], buckets=4096)
    place, upto = F.lit(shards - 1), 0
    ends = []
    for s in range(shards):
        upto += total // shards + (s < total % shards) - loads.get(s, 0)
        ends.append(upto)
    for s in reversed(range(shards - 1)):
        place = F.when(F.col("position") < ends[s], F.lit(s)).otherwise(place)
    filled = alone.withColumn("shard", place.cast("int")).drop("all", "position")
    both = lasting(met.where("shard is not null").unionByName(filled))
    return placed(both, ["shard"], ["order", "row"], name="slot")


def cut_share(sharded: DataFrame, links: DataFrame) -> DataFrame:
    """One row: linked documents and those that do not share a shard with most of a group."""
    counts = links.join(sharded.select("row", "shard"), "row").groupBy("group", "shard").agg(F.count("*").alias("n"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return groups.agg(F.sum("all").alias("linked"), F.sum(F.col("all") - F.col("most")).alias("apart"))


def pairs_together(sharded: DataFrame, links: DataFrame) -> DataFrame:
    """One row: linked pairs (per group) and those that share a shard."""
    counts = links.join(sharded.select("row", "shard"), "row").groupBy("group", "shard").agg(F.count("*").alias("n"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("together"))
    return groups.agg(F.sum(F.col("all") * (F.col("all") - 1) / 2).alias("pairs"), F.sum("together").alias("together"))


def _sharded(slim: DataFrame, shards: int, rounds: int) -> DataFrame:
    """The slim rows of documents linked by equal texts, in shards of equal row counts."""
    return shard(slim, lasting(text_links(slim)), shards, rounds)


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _results(sharded: DataFrame, *first: str) -> DataFrame:
    return sharded.select(
        *first,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_texts(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Documents linked by equal texts, in shards of equal row counts."""
    return _results(_sharded(documents(docs), shards, rounds), "doc_id")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The same with all columns of the documents, for shards that are trained on.

    Rows are numbered and written once, so that repeated rows find their own shard and slot.
    """
    row = unused(docs, "_row")
    own = docs.drop(*(c for c in docs.columns if c.lower() in RESULT))
    numbered = lasting(own.withColumn(row, F.monotonically_increasing_id()))
    placed_rows = _results(_sharded(documents(numbered, row), shards, rounds), "row").withColumnRenamed("row", row)
    return numbered.join(placed_rows, row).drop(row)
