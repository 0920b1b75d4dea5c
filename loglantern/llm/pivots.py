"""Near duplicates by SimHash fingerprints that a table of distances to reference fingerprints compares.

A fingerprint has 64 bits; two link if they differ in three or fewer. The table holds its
Hamming distances to reference fingerprints. Distances of two fingerprints to one reference
differ by no more than they differ themselves, so a pair with a larger difference in any
coordinate is discarded; only survivors are compared bit by bit.

Fingerprints of unlike texts lie 32 bits off any reference, give or take four: distances to
whole references alone would let nearly half of all pairs meet per coordinate. References
therefore come in twins that differ in one band of bits only. The difference of the
distances to twins is the distance within that band. Three changed bits leave two of five
bands as they are, so linked fingerprints have equal coordinates in two bands: these rows of
the table are the buckets in which pairs meet, ten per fingerprint. Buckets of more than
``LIMIT`` fingerprints are split again by twins of five bands of the bits not yet used, and
these again; after three rounds 14 bits at most are left, so that a bucket holds 16,384
different fingerprints at most, by nature. No link is lost: each step only discards pairs that
the references prove to be more than three bits apart.

Equal fingerprints are one row from the start. A bucket yields a star of links for each of
its connected groups, not its pairs; classes are connected components of these stars.

Shingles are three words, lower-cased in A-Z, words being what ASCII blanks separate; a text
of one or two words is one shingle. A bit is set if it is in more than half of the shingles'
XXH64 hashes (seed 42), repeats included. Defined cases: null and blank texts have
fingerprint zero and link like any other; repeated rows share a class; a class is named by
its least id, null ids only if it has no other; other columns are ignored; an empty table
gives no rows. Very long texts are hashed in pieces.
"""

from __future__ import annotations

import sys
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.chosen_path import components
from loglantern.llm.common import lasting

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, SEED, RADIUS = 3, 42, 3
#: Bands of bits, of which a pair within the radius shares ``SHARED``; rounds of splitting.
BANDS = RADIUS + 2
SHARED = BANDS - RADIUS
ROUNDS = 3
#: Fingerprints of a bucket that is compared as it is, before the last round.
LIMIT = 4096
#: Reference fingerprints (each with a twin per band).
REFERENCES = 16
#: Hashes whose bits are counted at once.
PIECE = 1 << 16


def references(n: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def distances(prints: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The table: Hamming distances of all fingerprints (rows) to all references (columns)."""
    return np.bitwise_count(prints[:, None] ^ to[None, :]).astype(np.int8)


def within(prints: np.ndarray, band: int, to: np.ndarray) -> np.ndarray:
    """Distances to the references within a band of bits, from those to references and their twins."""
    twins = distances(prints, to ^ np.uint64(band))
    return (distances(prints, to) - twins + band.bit_count()) >> 1


def bands(used: int) -> list[int]:
    """The bits not in ``used`` cut into ``BANDS`` masks of nearly equal size."""
    free = [b for b in range(64) if not used >> b & 1]
    cuts = [len(free) * i // BANDS for i in range(BANDS + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _hash(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number per row of small numbers; equal rows are equal."""
    found = start.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for column in rows.T:
        found = (found ^ column.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        found ^= found >> np.uint64(32)
    return found


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprint of every text."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    ends: list[int] = []

    def count():
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[owners] += np.add.reduceat(bits, ends, axis=0, dtype=np.int64)
            totals[owners] += np.diff([*ends, len(hashes)])
        hashes.clear(), owners.clear(), ends.clear()

    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        places = max(len(words) - WORDS + 1, 1) if words else 0
        for start in range(0, places, PIECE):
            owners.append(i)
            ends.append(len(hashes))
            upto = min(start + PIECE, places)
            part = words[start : upto + WORDS - 1]
            grams = zip(part, part[1:], part[2:], strict=False) if len(words) >= WORDS else [words]
            hashes += [digest(join(gram), SEED) for gram in grams]
            if len(hashes) >= PIECE:
                count()
    count()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every document."""

    def work(batches):
        for batch in batches:
            made = fingerprints(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "print"])

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(work, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, print long")


def bucketed(rows: DataFrame) -> DataFrame:
    """(bucket, used, print): each of (bucket, used, print) in a bucket per choice of bands that may have stayed equal.

    ``used`` marks the bits in which all prints of a bucket agree.
    """
    to = references()

    def work(batches):
        for batch in batches:
            bucket, used, prints = (np.asarray(batch.column(c)).view(np.uint64) for c in ("bucket", "used", "print"))
            for mask in np.unique(used):
                mine = used == mask
                cut = bands(int(mask))
                tables = [within(prints[mine], band, to) for band in cut]
                for chosen in combinations(range(BANDS), SHARED):
                    key = _hash(np.hstack([tables[b] for b in chosen]), bucket[mine] + np.uint64(sum(1 << b for b in chosen)))
                    now = int(mask) | sum(cut[b] for b in chosen)
                    made = [key, np.full(len(key), now, np.uint64), prints[mine]]
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)) for m in made], ["bucket", "used", "print"])

    return rows.select("bucket", "used", "print").mapInArrow(work, "bucket long, used long, print long")


def stars(bucket: np.ndarray, prints: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that tie the linked fingerprints of each bucket; buckets lie together."""
    n = len(prints)
    table = distances(prints, to)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [n]])
    ends = np.repeat(cuts[1:], np.diff(cuts))
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    left, step = np.arange(n), 1
    while len(left := left[left + step < ends[left]]):
        apart = left[root[left] != root[left + step]]
        near = np.abs(table[apart] - table[apart + step]).max(axis=1, initial=0) <= RADIUS
        apart = apart[near]
        linked = apart[np.bitwise_count(prints[apart] ^ prints[apart + step]) <= RADIUS]
        for i in linked.tolist():
            u, v = top(i), top(i + step)
            root[max(u, v)] = min(u, v)
        while len(linked) and not np.array_equal(root, flat := root[root]):
            root[:] = flat
        step += 1
    tied = np.flatnonzero(root != np.arange(n))
    return prints[tied], prints[root[tied]]


def compared(rows: DataFrame) -> DataFrame:
    """(a, b): links that connect all linked fingerprints of each bucket."""
    to = references()

    def work(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                new = np.array([np.asarray(batch.column(c)) for c in ("bucket", "print")])
                rest = new if rest is None else np.hstack([rest, new])
            if rest is None or not rest.shape[1]:
                continue
            bucket = rest[0]
            # the last bucket may go on in the next batch
            ready = len(bucket) if batch is None else int(np.searchsorted(bucket, bucket[-1]))
            if not ready:
                continue
            a, b = stars(bucket[:ready], rest[1, :ready].view(np.uint64), to)
            rest = rest[:, ready:].copy()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = rows.select("bucket", "print").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "a long, b long")


def _with_end(batches):
    """The batches and a last None."""
    yield from batches
    yield None


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all fingerprints of (print) within the radius; prints must differ."""
    found = []
    rows = prints.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("used"), "print")
    for number in range(1, ROUNDS + 1):
        rows = bucketed(rows)
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        met = lasting(rows.join(sizes, "bucket"))
        last = number == ROUNDS
        found.append(compared(met if last else met.where(F.col("size") <= limit)))
        rows = met.where(F.col("size") > limit)
        if last or rows.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, print, component_id): a row per document; ``component_id`` is the least id of its class."""
    told = lasting(printed(docs))
    prints = lasting(told.groupBy("print").agg(F.min("doc_id").alias("first")))
    rooted = components(lasting(links(prints, limit))).withColumnRenamed("node", "print")
    named = rooted.join(prints, "print")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    classes = named.select("print", "root").join(least, "root").select("print", "least")
    label = prints.join(classes, "print", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    return told.join(label, "print").select("doc_id", "print", "component_id")
