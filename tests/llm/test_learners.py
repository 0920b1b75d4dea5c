"""Hashed words, the quality classifier and ordinal toxicity."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

from loglantern.llm import hashed_words as hw
from loglantern.llm import quality, toxicity
from loglantern.llm.common import table
from loglantern.llm.queries import QUERIES, held_out

TEXTS = ["", None, "one", " two  two\n", "Größe straße", "a-b c--d", "x" * 5000, None, "tail end ", ""]


def spans(text, pattern):
    return [m.span() for m in re.finditer(pattern, text.encode())]


@pytest.mark.parametrize("kinds, pattern", [(hw.WORDS, rb"[^ \t-\r]+"), (hw.LETTERS, rb"[0-9A-Za-z\x80-\xff]+"),
    (hw.WORDS_AND_SIGNS, rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+")])
@pytest.mark.parametrize("size", [hw.SLICE, 8])
def test_words_are_those_of_a_plain_search(monkeypatch, kinds, pattern, size):
    monkeypatch.setattr(hw, "SLICE", size)
    seen, by_bytes = {}, {}
    for piece in hw.slices(pa.array(TEXTS), kinds):
        for text, h, n in zip(piece.text, piece.hash, piece.end - piece.start, strict=True):
            seen.setdefault(piece.first + int(text), []).append((int(n), int(h)))
    for i, text in enumerate(TEXTS):
        cut = spans(text or "", pattern)
        assert [n for n, _ in seen.get(i, [])] == [b - a for a, b in cut]
        for (a, b), (_, h) in zip(cut, seen.get(i, []), strict=True):
            assert by_bytes.setdefault(text.encode()[a:b], h) == h
    assert len(set(by_bytes.values())) == len(by_bytes)


def test_ngrams_stay_within_texts():
    piece = next(hw.slices(pa.array(["a b c", "d", "e f"]), hw.WORDS))
    h, text = hw.ngrams(piece, 2)
    assert text.tolist() == [0, 0, 2] and len(set(h.tolist())) == 3


def test_ftrl_steps_are_those_of_the_plain_algorithm():
    pick = random.Random(1)
    examples = [(np.array(sorted(pick.sample(range(20), 4))), np.array([pick.random() for _ in range(4)]), pick.randint(0, 1)) for _ in range(50)]
    z, n = np.zeros(quality.SLOTS + 1), np.zeros(quality.SLOTS + 1)
    quality.follow(z, n, examples)
    zz, nn = [0.0] * 20, [0.0] * 20
    for slots, x, label in examples:
        w = []
        for i in slots:
            sign = float(np.sign(zz[i]))
            w.append(0.0 if abs(zz[i]) <= quality.L1 else -(zz[i] - sign * quality.L1) / ((quality.BETA + nn[i] ** 0.5) / quality.ALPHA + quality.L2))
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, v, a in zip(slots, x, w, strict=True):
            g = (p - label) * v
            zz[i] += g - ((nn[i] + g * g) ** 0.5 - nn[i] ** 0.5) / quality.ALPHA * a
            nn[i] += g * g
    assert np.allclose(z[:20], zz) and np.allclose(n[:20], nn)


def test_scores_are_dot_products_of_the_rows(spark):
    texts = [t for t in TEXTS if t is not None] + ["Yes no no yes!!"]
    rows = list(quality.rows(pa.array(texts)))
    assert len(rows) == len(texts)
    model = np.random.default_rng(1).normal(size=quality.SLOTS + 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, (slots, x) in enumerate(rows):
        assert abs(got[i] - quality.sigmoid(model.astype(np.float32)[slots] @ x)) < 1e-5


def test_quality_of_held_out_documents(spark):
    """Trained on the larger table, which has enough labels to tell."""
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op9_ftrl_quality"](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    rows = scored.select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) and len(rows) > 500
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) >= 0.99 * len(good)


def test_labels_of_held_out_documents_are_never_read(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, x.where(~held_out())) for x in (labels, turned))
    assert np.array_equal(one, two)


def test_an_id_is_learned_from_once(spark):
    """Repeats of an id, of equal or of other texts, leave one row of it in the sample."""
    rows = [(n, f"text number {n}") for n in range(20)] + [(3, "text number 3")] * 50 + [(4, f"other {n}") for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(n, n % 2) for n in range(15)], "doc_id long, label int")
    got = quality.sample_features(docs.repartition(4), sample)
    assert got.count() == got.select("order").distinct().count() == 15
    again = quality.sample_features(docs.repartition(3), sample)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_odd_rows_are_scored(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (8, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd_documents, labels)
    rows = quality.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(blank) == 1
    assert quality.score(no_documents, model).count() == 0
    nothing = quality.train(odd_documents, labels.where("false"))
    assert {r.score for r in quality.score(odd_documents, nothing).collect()} == {0.5}


def test_gradients_are_slopes_of_the_loss():
    pick = np.random.default_rng(3)
    slot, at = pick.integers(0, 30, 40), np.array([0, 10, 15, 15, 28, 40])
    grade = np.array([0, 1, 2, 2, 0])
    weights = np.zeros(toxicity.SLOTS)
    weights[:30] = pick.normal(size=30)
    base = toxicity.Model(weights, np.array([0.3, 1.4]))
    g, t, loss = toxicity.gradients(base, slot, at, grade)
    for i in range(30):
        moved = weights.copy()
        moved[i] += 1e-6
        assert abs((toxicity.gradients(toxicity.Model(moved, base.thresholds), slot, at, grade)[2] - loss) / 1e-6 - g[i]) < 1e-3
    for k in range(2):
        moved = base.thresholds.copy()
        moved[k] += 1e-6
        assert abs((toxicity.gradients(toxicity.Model(weights, moved), slot, at, grade)[2] - loss) / 1e-6 - t[k]) < 1e-3


def test_toxic_documents_are_told_from_clean_ones(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    assert list(model.thresholds) == sorted(model.thresholds)
    told = labels.where(held_out()).select("doc_id", F.col("toxic").alias("label"))
    rows = toxicity.score(docs, model, ["doc_id"]).join(told, "doc_id").collect()
    bad, clean = ([r.toxic for r in rows if r.label == x] for x in (1, 0))
    assert sum(bad) >= 0.75 * len(bad) and sum(clean) <= 0.01 * len(clean) and len(bad) > 50
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in rows)


def test_odd_rows_have_a_severity(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (8, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_documents.withColumn("severity", F.lit("clash")), labels)
    rows = toxicity.score(odd_documents.withColumn("severity", F.lit("clash")), model).collect()
    assert len(rows) == odd_documents.count() and len({r.severity for r in rows if r.doc_id in (3, 4, 5, 7)}) == 1
    assert toxicity.score(no_documents, model).count() == 0
    nothing = toxicity.train(no_documents, labels.where("false"))
    assert {r.toxic for r in toxicity.score(odd_documents, nothing).collect()} == {0}
