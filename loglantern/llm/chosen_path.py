"""Near duplicates by a chosen-path similarity join on five-word shingles.

Each document becomes the set of its hashed shingles; documents of one set are copies and go
on as one set. A run draws tokens by a hash that all sets share, ``BRANCHES`` per set on
average, and puts a set into the bucket of each. Buckets of more than ``LIMIT`` sets are split
by tokens drawn anew, up to ``DEPTH`` levels down; what is still large then is compared in
blocks of ``LIMIT``, so nothing is left out. Within a bucket all sets meet (brute force): a
sketch of 128 bytes rules out pairs that are far apart, and a pair goes on only from the
first bucket it shares, so each pair is made once. Pairs are then compared exactly, by their
whole sets. Runs are repeated until a pair at the threshold is found with ``RECALL``.

Links between sets give classes: connected components by alternating stars. Each document
gets the least id of its class and the number of documents it is linked to, copies included.

Words are runs of letters and digits, lower-cased; a text of one to four words is one
shingle; shingles are 48-bit hashes. Defined cases: texts that are null or hold no word are
linked to nothing and are classes of their own; repeated rows are copies; null ids are
documents like any other but name a class only if it has no other id. Other columns are
ignored. Memory follows ``LIMIT`` sets.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting, unused
from loglantern.llm.hashed_words import LETTERS, mixed, ngrams, slices

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY = 5, 0.8
BRANCHES, DEPTH, RECALL = 3.0, 3, 0.999
#: Sets that are compared with one another at once.
LIMIT = 5000
BINS = 128
#: Sketches may fall short of the threshold by so many standard deviations; at 4 the two tests
#: together rule out at most one in 10,000 pairs at the threshold, on top of ``RECALL``.
SLACK = 4.0
#: Sets of a tile, in which sketches are compared at once.
TILE = 512
#: Sets whose tokens are held by one task while pairs are compared (expected).
GROUP_SETS = 1024

TOKEN_BITS = 48
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)


def runs_for(recall: float, least: float = SIMILARITY, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, split to the last level."""
    met = (1 - math.exp(-branches * least)) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def shingle_sets(texts: pa.Array):
    """Per slice of texts: first text, number of texts, and the sorted distinct (text, token) pairs."""
    for piece in slices(pc.utf8_lower(texts), LETTERS, (1 << 16) - 1):
        counts = piece.counts()
        parts = [ngrams(piece, SHINGLE)]
        for n in range(1, SHINGLE):
            h, text = ngrams(piece, n)
            short = counts[text] == n
            parts.append((h[short], text[short]))
        h, text = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        both = np.unique((text.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> np.uint64(64 - TOKEN_BITS)))
        yield piece.first, piece.texts, (both >> np.uint64(TOKEN_BITS)).astype(np.int64), both & TOKEN_MASK


def _nested(values: np.ndarray, owner: np.ndarray, owners: int) -> pa.Array:
    """Lists of values by owner; ``owner`` need not be sorted."""
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(owners + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order].astype(np.int64)))


def described(docs: DataFrame, runs: int, branches: float = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, key, a, b, n, sketch, drawn) per document: set identity and size, sketch, tokens drawn per run and level."""
    lists = runs * depth

    def describe(n_texts: int, text: np.ndarray, token: np.ndarray) -> dict[str, pa.Array]:
        n = np.bincount(text, minlength=n_texts)
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        held = text[starts]
        a, b = np.zeros(n_texts, np.uint64), np.zeros(n_texts, np.uint64)
        if len(starts):
            a[held] = np.add.reduceat(mixed(token), starts)
            b[held] = np.bitwise_xor.reduceat(mixed(token ^ np.uint64(0x2545F4914F6CDD1D)), starts)
        place = text * BINS + (token >> np.uint64(TOKEN_BITS - 7)).astype(np.int64)
        least = np.flatnonzero(np.diff(place, prepend=-1))
        sketch = np.zeros(n_texts * BINS, np.uint8)
        sketch[place[least]] = mixed(token[least]) % np.uint64(255) + np.uint64(1)
        share = np.minimum(branches / np.maximum(n, 1), 1.0)
        bar = np.minimum(share * 2.0**64, 2.0**64 - 2049).astype(np.uint64)[text]
        every = share[text] >= 1
        drawn, owner = [], []
        for i in range(lists):
            mine = np.flatnonzero((mixed(token + np.uint64((i + 1) << TOKEN_BITS)) < bar) | every)
            drawn.append(token[mine])
            owner.append(text[mine] * lists + i)
        flat = _nested(np.concatenate(drawn), np.concatenate(owner), n_texts * lists)
        nested = pa.ListArray.from_arrays(pa.array(np.arange(n_texts + 1) * lists, pa.int32()), flat)
        ends = pa.py_buffer((np.arange(n_texts + 1) * BINS).astype(np.int32))
        sketches = pa.Array.from_buffers(pa.binary(), n_texts, [None, ends, pa.py_buffer(sketch)])
        return {"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "n": pa.array(n.astype(np.int32)), "sketch": sketches, "drawn": nested}

    def batches(given):
        for batch in given:
            done, none = 0, (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            stretches = []
            for first, count, text, token in shingle_sets(batch.column("text")):
                if first > done:
                    stretches.append((done, describe(first - done, *none)))
                stretches.append((first, describe(count, text, token)))
                done = first + count
            if done < batch.num_rows:
                stretches.append((done, describe(batch.num_rows - done, *none)))
            for first, made in stretches:
                part = batch.slice(first, len(made["n"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *made.values()], ["doc_id", "key", *made])

    slim = docs.select("doc_id", _row_key().alias("key"), "text")
    kept = slim.select("doc_id", "key").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return slim.mapInArrow(batches, f"{schema}, a long, b long, n int, sketch binary, drawn array<array<long>>")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def distinct_sets(described_docs: DataFrame) -> DataFrame:
    """One row per set that holds shingles: id, size, sketch, drawn tokens, copies, and a document to read it from."""
    held = described_docs.where("n > 0")
    one = held.groupBy("a", "b").agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("rep"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
        F.first("drawn").alias("drawn"),
    )
    return lasting(one.withColumns({"key": F.col("rep.key"), "sid": F.monotonically_increasing_id()}))


def buckets(sets: DataFrame, runs: int, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """(bucket, sid, chunks): final buckets of two sets or more; ``chunks`` over 1 asks for blocks."""
    token = F.explode(F.get("drawn", F.col("run") * depth))
    rows = sets.select("sid", "drawn", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("sid", "run", token.alias("token"))
    rows = rows.select("sid", "run", F.xxhash64("run", "token").alias("bucket"))
    final = []
    for level in range(1, depth + 1):
        counts = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        met = lasting(rows.join(counts, "bucket"))
        last = level == depth
        final.append(met if last else met.where(F.col("size") <= limit))
        if last:
            break
        large = met.where(F.col("size") > limit)
        if large.isEmpty():
            break
        deeper = F.explode(F.get("drawn", F.col("run") * depth + level)).alias("token")
        rows = large.join(sets.select("sid", "drawn"), "sid").select("sid", "run", "bucket", deeper)
        rows = rows.select("sid", "run", F.xxhash64("bucket", "token").alias("bucket"))
    every = reduce(DataFrame.unionByName, final)
    return every.select("bucket", "sid", F.ceil(F.col("size") / limit).cast("int").alias("chunks"))


def agreeing(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs whose sizes and sketches may belong to sets of similarity ``least``.

    Bins of both sets agree with the chance of their similarity. Bits are compared first
    (bytes that differ do so in four bits on average), then bytes: more differences than
    chance explains rule a pair out.
    """
    differ = np.zeros((len(x), len(y)), np.uint16)
    one, two = x.view(np.uint64), y.view(np.uint64)
    for k in range(one.shape[1]):
        differ += np.bitwise_count(one[:, k, None] ^ two[None, :, k])
    small, large = np.minimum(nx[:, None], ny[None, :]), np.maximum(nx[:, None], ny[None, :])
    bins = np.minimum(float(BINS), large / least)
    bits = 4 * (1 - least) * bins + SLACK * np.sqrt((1 - least) * (2 + 16 * least) * bins) + 4
    i, j = np.nonzero((differ <= bits) & (small >= large * least))
    unequal = np.count_nonzero(x[i] != y[j], axis=1)
    bins = bins[i, j]
    good = unequal <= (1 - least) * bins + SLACK * np.sqrt(least * (1 - least) * bins) + 1
    return i[good], j[good]


def candidate_pairs(sets: DataFrame, placed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs of sets that may be similar, each once, packed by tile of a bucket.

    Rows (bucket, sids, left, right): ``left`` and ``right`` are places in ``sids``.
    """
    own = placed.groupBy("sid").agg(F.sort_array(F.collect_set(F.struct("bucket", "chunks"))).alias("own"))  # a few per run
    known = sets.select("sid", "n", "sketch").join(own, "sid").withColumn("homes", F.col("own.bucket"))
    rows = known.select("sid", "n", "sketch", "homes", F.inline("own"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    units = rows.withColumn("other", F.explode(every)).withColumn("unit", F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    slim = units.select("unit", "bucket", side.alias("side"), "sid", "n", "sketch", "homes")

    def compare(part: pa.Table):
        side, sid, n = (np.asarray(part.column(c)) for c in ("side", "sid", "n"))
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        homes, bucket = part.column("homes").to_pylist(), part.column("bucket")[0].as_py()
        lefts = np.flatnonzero(side < 2)
        rights = np.flatnonzero(side == 0) if side[0] == 0 else np.flatnonzero(side == 2)
        for a in range(0, len(lefts), TILE):
            for b in range(0, len(rights), TILE):
                x, y = lefts[a : a + TILE], rights[b : b + TILE]
                i, j = agreeing(sketch[x], sketch[y], n[x], n[y], least)
                i, j = x[i], y[j]
                if side[0] == 0:
                    i, j = i[i < j], j[i < j]
                # counted in the first bucket that both are in
                first = [p for p, (u, v) in enumerate(zip(i, j, strict=True)) if min(set(homes[u]).intersection(homes[v])) == bucket]
                if first:
                    used, place = np.unique(np.concatenate([i[first], j[first]]), return_inverse=True)
                    yield bucket, sid[used], place[: len(first)], place[len(first) :]

    def meet(given):
        rest = None
        for batch in _with_end(given):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                rest = new if rest is None else pa.concat_tables([rest, new])
            if rest is None or not rest.num_rows:
                continue
            unit = np.asarray(rest.column("unit"))
            cuts = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
            ready = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last unit may go on
            out = []
            for a, b in zip(cuts[:ready], cuts[1 : ready + 1], strict=True):
                if b - a > 1:
                    out += compare(rest.slice(a, b - a))
            rest = rest.slice(cuts[ready])
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.list_(pa.int64())),
                        *(pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in (2, 3)),
                    ],
                    ["bucket", "sids", "left", "right"],
                )

    dealt = slim.repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(meet, "bucket long, sids array<long>, left array<int>, right array<int>")


def _with_end(batches):
    """The batches and a last None."""
    yield from batches
    yield None


def links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(sid, others, root): per set and group of tiles the documents it is linked to, by exact comparison.

    ``root`` is the least set it is connected to within the group. A pair lies in one tile,
    so sums of ``others`` count each link once, and no row is made per link. A set travels to
    the groups its tiles are in, not once per pair; only sets that are in a pair are read again.
    """
    used = pairs.agg(F.sum(F.size("sids"))).first()[0] or 0
    groups = max(1, -(-used // GROUP_SETS))
    tile = F.xxhash64("bucket", F.get("sids", 0), F.size("left"))
    group = F.pmod(tile, F.lit(groups)).cast("int").alias("group")
    wanted = pairs.select(group, F.explode("sids").alias("sid")).groupBy("sid").agg(F.collect_set("group").alias("groups"))
    readable = wanted.join(sets.select("sid", "key", "copies"), "sid")

    def tokens(given):
        for batch in given:
            for first, n, text, token in shingle_sets(batch.column("text")):
                ends = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                part = batch.slice(first, n)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(token.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("sid"), part.column("copies"), part.column("groups"), lists], ["sid", "copies", "groups", "tokens"])

    texts = docs.select(_row_key().alias("key"), "text").join(readable, "key").select("sid", "copies", "groups", "text")
    read = texts.mapInArrow(tokens, "sid long, copies long, groups array<int>, tokens array<long>")
    sent = read.select(F.explode("groups").alias("group"), "sid", "copies", "tokens")

    def compare(asked, held):
        if not asked.num_rows or not held.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("sid", "others", "root")})
        lists = held.column("tokens").combine_chunks()
        at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        sid, copies = np.asarray(held.column("sid")), np.asarray(held.column("copies"))
        where = {int(s): i for i, s in enumerate(sid)}
        tokens = [flat[at[i] : at[i + 1]] for i in range(len(sid))]
        others, parent = np.zeros(len(sid), np.int64), list(range(len(sid)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for sids, left, right in zip(*(asked.column(c).to_pylist() for c in ("sids", "left", "right")), strict=True):
            place = [where[s] for s in sids]
            for x, y in zip(left, right, strict=True):
                i, j = place[x], place[y]
                one, two = tokens[i], tokens[j]
                spot = np.searchsorted(two, one)
                common = np.count_nonzero(two[np.minimum(spot, len(two) - 1)] == one)
                if common >= least * (len(one) + len(two) - common):
                    others[i] += copies[j]
                    others[j] += copies[i]
                    u, v = top(i), top(j)
                    if u != v:
                        u, v = (u, v) if sid[u] < sid[v] else (v, u)
                        parent[v] = u
        linked = np.flatnonzero(others)
        roots = sid[[top(int(i)) for i in linked]] if len(linked) else np.zeros(0, np.int64)
        return pa.table({"sid": sid[linked], "others": others[linked], "root": roots})

    asked = pairs.select(group, "sids", "left", "right").groupBy("group")
    return asked.cogroup(sent.groupBy("group")).applyInArrow(compare, "sid long, others long, root long")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of all nodes in edges (a, b): alternating large and small stars until all are stars."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        """Ties a node's larger (or all smaller) neighbours to the least of them and itself."""
        both = pairs if small else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        ties = met.where(F.col("v") != F.col("m") if small else F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if small:
            ties = ties.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        return ties.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    now = lasting(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    for _ in range(most_rounds):
        now = lasting(star(star(now, small=False), small=True))
        # in a table of stars no root is tied to another node
        if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not connected after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, recall: float = RECALL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, key, class_id, class_size, links, keeper): a row per document.

    ``key`` hashes id and text; ``keeper`` is the key of the class's document of least id.
    """
    runs = runs_for(recall, least)
    told = lasting(described(docs, runs))
    sets = distinct_sets(told)
    pairs = lasting(candidate_pairs(sets, buckets(sets, runs, limit=limit), least))
    linked = lasting(links(docs, sets, pairs, least))
    slim = sets.select("sid", "a", "b", "copies", "rep")
    others = linked.groupBy("sid").agg(F.sum("others").alias("others"))
    edges = linked.where("sid != root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    rooted = lasting(components(edges).withColumnRenamed("node", "sid").join(others, "sid").join(slim.select("sid", "copies", "rep"), "sid"))
    classes = rooted.groupBy("root").agg(F.min("rep").alias("first"), F.sum("copies").alias("size"))
    told_of = rooted.select("sid", "root", "others").join(classes, "root").select("sid", "others", "first", "size")
    full = slim.join(told_of, "sid", "left").select(
        "a",
        "b",
        F.coalesce("first", "rep")["doc_id"].alias("class_id"),
        F.coalesce("size", "copies").alias("class_size"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        F.coalesce("first", "rep")["key"].alias("keeper"),
    )
    held = told.where("n > 0").select("doc_id", "key", "a", "b").join(full, ["a", "b"]).drop("a", "b")
    alone = told.where("n = 0").select(
        "doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(0).cast("long").alias("links"), F.col("key").alias("keeper"),
    )
    return held.unionByName(alone)


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents with one of each class left, whole; texts without words all stay.

    What goes is listed by key, and only that list is joined. Of repeated rows that would
    stay, which share a key, one stays.
    """
    key = unused(docs, "_key")
    found = lasting(near_duplicates(docs, least).select("key", "keeper", "class_size"))
    gone = found.where("key != keeper").select(F.col("key").alias(key)).distinct()
    again = found.where("key = keeper and class_size > 1").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n")).where("n > 1")
    own = _row_key() == F.col(key)
    single = docs.join(gone.unionByName(again.select(key)), own, "left_anti")
    repeated = docs.join(again.select(key), own).dropDuplicates([key]).select(*docs.columns)
    return single.unionByName(repeated)
