"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Words are runs of letters or of other signs; features are hashes of words and of pairs of
adjacent words (a word that follows itself counts as the pair "repeated"), weighted by their
share of the text, so that long texts weigh like short ones. The model is two numbers per
hash slot, learned on a bounded sample of labelled documents: ``SHARDS`` fixed parts learn
side by side for one pass and their states are averaged, ``ROUNDS`` times over. Scores are
sparse dot products over whole texts, in one pass without a shuffle.

Defined cases: null and blank texts have the constant feature only; labels that are null are
left out, a document with several labels counts as good if most are; without labelled rows
every score is a half. Repeated documents are scored each and learned from once. Columns of the input are kept,
equally named results replace them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting
from loglantern.llm.hashed_words import WORDS_AND_SIGNS, mixed, ngrams, slices

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS = 1 << 18
#: Bound of the labelled sample a model is learned from (expected number of documents).
MOST_LABELLED = 20_000
SHARDS, ROUNDS, PASSES = 4, 3, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.01
SCALE = 8.0
THRESHOLD = 0.3
REPEATED = np.uint64(0x5DEECE66D)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: its first text, and of each feature the text, slot and weight."""
    for piece in slices(texts, WORDS_AND_SIGNS):
        pairs, pair_text = ngrams(piece, 2)
        again = piece.hash[1:] == piece.hash[:-1]
        pairs[again[piece.text[1:] == piece.text[:-1]]] = REPEATED
        text = np.concatenate([piece.text, pair_text])
        slot = np.concatenate([piece.hash, mixed(pairs)]) % np.uint64(SLOTS)
        size = np.maximum(piece.counts(), 1)
        yield piece.first, text, slot.astype(np.int64), (SCALE / size)[text]


def rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and weights of each text, equal slots added up; the last slot is the constant."""
    done = 0
    for first, text, slot, weight in features(texts):
        for _ in range(done, first):
            yield np.array([SLOTS]), np.array([1.0])
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(text.max(initial=-1) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            slots, place = np.unique(slot[own], return_inverse=True)
            yield np.append(slots, SLOTS), np.append(np.bincount(place, weight[own], len(slots)), 1.0)
        done = first + len(cuts) - 1
    for _ in range(done, len(texts)):
        yield np.array([SLOTS]), np.array([1.0])


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that an FTRL state stands for."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def follow(z: np.ndarray, n: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One pass of FTRL-proximal updates, in place."""
    for slots, x, label in examples:
        w = weights(z[slots], n[slots])
        g = (sigmoid(w @ x) - label) * x
        root = np.sqrt(n[slots])
        z[slots] += g - (np.sqrt(n[slots] + g * g) - root) / ALPHA * w
        n[slots] += g * g


def labelled_sample(labels: DataFrame, column: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, label) of about ``most`` labelled documents at most, chosen by hash."""
    votes = labels.where(F.col(column).isNotNull()).groupBy("doc_id").agg(F.avg(column).alias("share"))
    known = votes.where("doc_id is not null").select("doc_id", (F.col("share") >= 0.5).cast("int").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def sample_features(docs: DataFrame, sample: DataFrame, parts: int = SHARDS) -> DataFrame:
    """(part, order, label, slots, weights) of the sampled documents, kept for many passes.

    The sample is bounded by its size, and so may be broadcast; texts never leave their task.
    An id is learned from once, however many rows it has: by the text of least hash, which
    each task passes on once at most.
    """

    def batches(given):
        seen = set()  # ids of the sample
        for batch in given:
            new = []
            for place, order in enumerate(batch.column("order").to_pylist()):
                if order not in seen:
                    seen.add(order)
                    new.append(place)
            batch = batch.take(pa.array(new, pa.int32()))
            slots, values = [], []
            for s, v in rows(batch.column("text")):
                slots.append(s)
                values.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part").cast(pa.int32()),
                    batch.column("order").cast(pa.int64()),
                    batch.column("label").cast(pa.int32()),
                    batch.column("n").cast(pa.int64()),
                    pa.array(slots, pa.list_(pa.int64())),
                    pa.array(values, pa.list_(pa.float64())),
                ],
                ["part", "order", "label", "n", "slots", "weights"],
            )

    order = F.xxhash64("doc_id", F.lit("order"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    least = hashed.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    chosen = hashed.join(F.broadcast(lasting(least)), ["doc_id", "hash"])
    slim = chosen.select("text", "label", "n", order.alias("order"), F.pmod(order, F.lit(parts)).cast("int").alias("part"))
    found = lasting(slim.mapInArrow(batches, "part int, order long, label int, n long, slots array<long>, weights array<double>"))
    # only ids of several rows, which several tasks may have passed on, are looked at again
    return found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["order"])).drop("n")


def examples_of(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(slots, weights, label) of a part's documents, in an order that is the same every time."""
    slots, values = (group.column(c).combine_chunks() for c in ("slots", "weights"))
    at, slot, value = np.asarray(slots.offsets), np.asarray(slots.values), np.asarray(values.values)
    order, label = np.asarray(group.column("order")), np.asarray(group.column("label"))
    ranked = np.lexsort((np.diff(at), label, order))
    return [(slot[at[i] : at[i + 1]], value[at[i] : at[i + 1]], int(label[i])) for i in ranked]


def learn(examples: DataFrame, rounds: int = ROUNDS, passes: int = PASSES, parts: int = SHARDS) -> np.ndarray:
    """The weights: parts learn side by side from the state so far, their states are averaged.

    A part holds a fixed share of the bounded sample; what comes back is one row per slot.
    """
    spark = examples.sparkSession
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def learned(group):
            z, n = (x.copy() for x in state.value)  # noqa: B023  pickled before the next round
            held = examples_of(group)
            for _ in range(passes):
                follow(z, n, held)
            touched = np.flatnonzero((z != 0) | (n != 0))
            return pa.table({"slot": touched, "z": z[touched], "n": n[touched]})

        states = examples.groupBy("part").applyInArrow(learned, "slot long, z double, n double")
        mean = states.groupBy("slot").agg((F.sum("z") / parts).alias("z"), (F.sum("n") / parts).alias("n")).toArrow()
        z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
        slot = np.asarray(mean["slot"])
        z[slot], n[slot] = np.asarray(mean["z"]), np.asarray(mean["n"])
    return weights(z, n)


def score(docs: DataFrame, model: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``score``, the probability that a whole text is good.

    ``keep`` names the columns that come back (all if None); the text need not be one of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.astype(np.float32))
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*kept).schema.add("score", "double")

    def batches(given):
        w = shared.value
        for batch in given:
            total = np.full(batch.num_rows, float(w[SLOTS]))
            for first, text, slot, weight in features(batch.column("text")):
                sums = np.bincount(text, weight * w[slot])
                total[first : first + len(sums)] += sums
            columns = [batch.column(c) for c in kept] + [pa.array(np.round(sigmoid(total), 9))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "score"])

    return docs.select(*kept, *{"text"}.difference(kept)).mapInArrow(batches, schema)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = MOST_LABELLED) -> np.ndarray:
    return learn(sample_features(docs, labelled_sample(labels, column, most)))
