"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features: lower-cased words and their beginnings of three to six bytes, hashed, each counted
once per text. All grades share one weight per slot; grade ``g`` is exceeded with
probability ``sigmoid(weights . features - threshold[g])`` and the thresholds are ordered.
The expected severity is the sum of these probabilities.

Learned on a bounded sample: in each round the few parts of the sample sum their gradients
(a number per slot that takes part, without a shuffle) and the driver takes one step with
adaptive step sizes and an L1 threshold that keeps chance features at zero.

Only slots that are likelier in toxic than in clean documents of the sample take part; equal
texts count once, so that copies do not make their every word a feature.

Grades: 0 is clean. Where labels only tell toxic from clean, toxic documents get grade 1 or
2 by how many different marker words they hold; markers are slots that are very much likelier
in toxic documents.

Defined cases: null and blank texts have no features and score by the thresholds alone; null
labels are left out; a document with several labels counts by their majority; without both
kinds of labels every document scores 0. Repeated documents are scored each. Columns named
like results are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.llm.common import lasting
from loglantern.llm.hashed_words import LETTERS, mixed, slices
from loglantern.llm.quality import labelled_sample, sigmoid

# workers get these functions themselves and need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS = 1 << 18
#: Bound of the labelled sample (expected number of documents).
MOST_LABELLED = 30_000
#: Parts the sample is kept in; each round they hand the driver one sum each.
PARTS = 8
PREFIXES = (3, 4, 5, 6)
GRADES = 3
ROUNDS, STEP, L1 = 25, 0.5, 5e-5
#: Slots that take part: in so many toxic documents, and so many times likelier there than in clean ones.
LEAST_TOXIC, LEAST_LIFT = 3, 4.0
#: Markers are so many times likelier; from so many on a document is severe.
MARKER_LIFT, SEVERE_MARKERS = 30.0, 3


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of texts: its first text and their number, and (text, slot) pairs, each once."""
    for piece in slices(pc.utf8_lower(texts), LETTERS):
        length = piece.end - piece.start
        spans = [piece.hash]
        owners = [piece.text]
        for n in PREFIXES:
            long = length > n
            start = piece.start[long]
            spans.append(mixed(piece.span_hash(start, start + n) + np.uint64(n)))
            owners.append(piece.text[long])
        slot = (np.concatenate(spans) % np.uint64(SLOTS)).astype(np.int64)
        pair = np.unique(np.concatenate(owners).astype(np.int64) * SLOTS + slot)
        yield piece.first, piece.texts, pair // SLOTS, pair % SLOTS


def sample_features(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(label, slots) of the sampled documents, equal texts once, kept for many passes."""

    def batches(given):
        for batch in given:
            slots = [np.zeros(0, np.int32)] * batch.num_rows
            for first, n, text, slot in features(batch.column("text")):
                cuts = np.searchsorted(text, np.arange(n + 1))
                for i in range(n):
                    slots[first + i] = slot[cuts[i] : cuts[i + 1]].astype(np.int32)
            columns = [batch.column("label").cast(pa.int32()), batch.column("key"), pa.array(slots, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "key", "slots"])

    key = F.xxhash64("text").alias("key")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", key)
    made = chosen.mapInArrow(batches, "label int, key long, slots array<int>")
    # a bounded sample: a few parts, however many the session shuffles into
    return lasting(made.dropDuplicates(["label", "key"]).select("label", "slots").coalesce(PARTS))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a batch's documents end to end, where each begins, and the labels."""
    lists = batch.column("slots")
    at = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[at[0] : at[-1]], at - at[0], np.asarray(batch.column("label"))


def lifts(examples: DataFrame) -> np.ndarray:
    """How many times likelier each slot is in toxic than in clean documents; 0 if seen too seldom."""

    def counted(given):
        toxic, clean, n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(2, np.int64)
        for batch in given:
            slot, at, label = _columns(batch)
            bad = np.repeat(label, np.diff(at)) > 0
            toxic += np.bincount(slot[bad], minlength=SLOTS)
            clean += np.bincount(slot[~bad], minlength=SLOTS)
            n += np.bincount(label > 0, minlength=2)
        seen = np.flatnonzero(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(toxic[seen], n[1])), pa.array(np.append(clean[seen], n[0]))],
            ["slot", "toxic", "clean"],
        )

    sums = examples.mapInArrow(counted, "slot long, toxic long, clean long")
    sums = sums.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = sums.where((F.col("toxic") >= LEAST_TOXIC) | (F.col("slot") < 0)).toPandas().set_index("slot")
    lift = np.zeros(SLOTS)
    if -1 in found.index:
        toxic, clean = found.loc[-1, "toxic"], found.loc[-1, "clean"]
        slots = found[found.index >= 0]
        lift[slots.index] = (slots.toxic / max(toxic, 1)) / ((slots.clean + 0.5) / max(clean, 1))
    return lift


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceeded(self, total: np.ndarray) -> np.ndarray:
        """Probability that each grade but the last is exceeded, a row per document."""
        return sigmoid(total[:, None] - self.thresholds[None, :])


def gradients(model: Model, slot: np.ndarray, at: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the mean-less log-likelihood loss by weight and threshold, and the loss."""
    text = np.repeat(np.arange(len(grade)), np.diff(at))
    total = np.bincount(text, model.weights[slot], len(grade))
    above = np.hstack([np.ones((len(grade), 1)), model.exceeded(total), np.zeros((len(grade), 1))])
    own = np.arange(len(grade))
    upper, lower = above[own, grade], above[own, grade + 1]
    chance = np.maximum(upper - lower, 1e-9)
    slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
    by_total = -(slope_up - slope_low) / chance
    by_threshold = np.zeros(len(model.thresholds) + 2)
    np.add.at(by_threshold, grade, slope_up / chance)
    np.add.at(by_threshold, grade + 1, -slope_low / chance)
    return np.bincount(slot, by_total[text], SLOTS), by_threshold[1:-1], float(-np.log(chance).sum())


def learn(examples: DataFrame, grades: int = GRADES, rounds: int = ROUNDS) -> Model:
    """Fits the model; each round is one pass over the bounded sample's slots."""
    spark = examples.sparkSession
    lift = lifts(examples)
    used = np.flatnonzero(lift >= LEAST_LIFT)
    shared_marks = spark.sparkContext.broadcast(lift >= MARKER_LIFT)
    shared_used = spark.sparkContext.broadcast(used)

    def graded(slot, at, label):
        hits = np.add.reduceat(np.append(shared_marks.value[slot], 0), np.minimum(at[:-1], len(slot))) * (np.diff(at) > 0)
        return np.where(label > 0, 1 + (hits >= SEVERE_MARKERS * (1 + len(PREFIXES))), 0).clip(0, grades - 1)

    model = Model(np.zeros(SLOTS), np.arange(2, grades + 1, dtype=float))
    squares, threshold_squares = np.full(SLOTS, 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

        def summed(given):
            now = Model(shared.value[0].astype(float), shared.value[1])  # noqa: B023  pickled before the next round
            by_slot, by_threshold, n = np.zeros(SLOTS), np.zeros(grades - 1), 0
            for batch in given:
                slot, at, label = _columns(batch)
                g, t, _ = gradients(now, slot, at, graded(slot, at, label))
                by_slot, by_threshold, n = by_slot + g, by_threshold + t, n + len(label)
            sums = np.concatenate([by_slot[shared_used.value], by_threshold, [float(n)]])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

        parts = examples.mapInArrow(summed, "sums binary").collect()  # PARTS rows of a number per used slot
        shared.unpersist()
        sums = np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0) if parts else np.zeros(len(used) + grades)
        n = max(sums[-1], 1.0)
        by_slot = np.zeros(SLOTS)
        by_slot[used] = sums[: len(used)] / n
        by_threshold = sums[len(used) : -1] / n
        squares += by_slot**2
        threshold_squares += by_threshold**2
        rate = STEP / np.sqrt(squares)
        stepped = model.weights - rate * by_slot
        model.weights = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * L1, 0.0)
        moved = model.thresholds - STEP / np.sqrt(threshold_squares) * by_threshold
        model.thresholds = np.maximum.accumulate(moved + 1e-3 * np.arange(grades - 1))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Documents with expected ``severity``, the likeliest ``grade`` and whether it is ``toxic`` at all."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    made = ("severity", "grade", "toxic")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    schema = docs.select(*kept).schema.add("severity", "double").add("grade", "integer").add("toxic", "integer")

    def batches(given):
        now = Model(*shared.value)
        for batch in given:
            total = np.zeros(batch.num_rows)
            for first, n, text, slot in features(batch.column("text")):
                total[first : first + n] = np.bincount(text, now.weights[slot], n)
            above = now.exceeded(total)
            chances = -np.diff(np.hstack([np.ones((len(total), 1)), above, np.zeros((len(total), 1))]), axis=1)
            grade = chances.argmax(axis=1)
            results = [
                pa.array(np.round(above.sum(axis=1), 9)),
                pa.array(grade, pa.int32()),
                pa.array((above[:, 0] >= 0.5).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + results, [*kept, *made])

    return docs.select(*kept, *{"text"}.difference(kept)).mapInArrow(batches, schema)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = MOST_LABELLED) -> Model:
    return learn(sample_features(docs, labelled_sample(labels, column, most)))
