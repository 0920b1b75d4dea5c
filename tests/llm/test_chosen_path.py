import itertools
import random
import re

import pytest
from llm_cases import ODD_SCHEMA
from pyspark.sql import functions as F

from loglantern.llm import chosen_path as cp


def brute(rows):
    """Links and classes by comparing every two sets of shingles."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(rows))], links


@pytest.fixture(scope="module")
def families():
    """Families of edited copies, exact copies and texts that share a passage."""
    pick = random.Random(11)
    vocabulary = [f"w{n}" for n in range(4000)]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    texts = []
    for family in range(12):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(20, 260))]
        for _ in range(pick.randint(1, 12)):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(base) // 60))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            texts.append(" ".join(copy))
            if family % 3 == 0:
                texts.append(" ".join(copy).upper())
    for _ in range(60):
        own = [pick.choice(vocabulary) for _ in range(80)]
        texts.append(" ".join(own[:40] + passage + own[40:]))
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [2000, 4])
def test_all_links_and_classes_are_found(spark, families, limit):
    """With a small limit buckets are split at every level and compared in blocks."""
    docs = spark.createDataFrame(families, "doc_id long, text string")
    found = {r.doc_id: r for r in cp.near_duplicates(docs, limit=limit, recall=0.99999).collect()}
    roots, links = brute(families)
    assert [found[i].links for i, _ in families] == links
    assert [found[i].class_id for i, _ in families] == roots
    assert all(found[i].class_size == roots.count(r) for i, r in enumerate(roots))
    assert sum(n > 0 for n in links) > 60


def test_pairs_are_made_once(spark, families):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    runs = cp.runs_for(0.999)
    sets = cp.distinct_sets(cp.described(docs, runs))
    for limit in (2000, 4):
        packed = cp.candidate_pairs(sets, cp.buckets(sets, runs, limit=limit)).collect()
        pairs = [tuple(sorted((r.sids[i], r.sids[j]))) for r in packed for i, j in zip(r.left, r.right, strict=True)]
        assert len(pairs) == len(set(pairs)) > 0


def test_runs_follow_the_recall():
    assert cp.runs_for(0.9) < cp.runs_for(0.999) < cp.runs_for(0.999999)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.class_id, r.class_size, r.links) for r in cp.near_duplicates(odd_documents).collect()]
    assert len(rows) == odd_documents.count()
    assert sorted(r for r in rows if r[0] in (1, 2)) == [(1, 1, 3, 2), (1, 1, 3, 2), (2, 1, 3, 2)]
    assert {r for r in rows if r[0] in (8, 9)} == {(8, 8, 2, 1), (9, 8, 2, 1)}
    assert {r for r in rows if r[0] in (3, 4, 5, 7)} == {(n, n, 1, 0) for n in (3, 4, 5, 7)}
    assert cp.near_duplicates(no_documents).count() == 0


def test_one_of_each_class_stays(spark, odd_documents, no_documents):
    kept = cp.deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "None", "4", "5", "6", "7", "8"])
    assert cp.deduplicated(no_documents).count() == 0


def test_components(spark):
    pick = random.Random(2)
    edges = [(n, n + 1) for n in range(0, 40)] + [(100, 100 + n) for n in range(1, 30)] + [(200 + pick.randrange(50), 200 + pick.randrange(50)) for _ in range(60)]
    found = {r.node: r.root for r in cp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_extra_columns_do_not_matter(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", "x", "s", 1, "r", 0.1, "k", 1)] * 2, ODD_SCHEMA)
    frame = frame.withColumns({"sid": F.lit(1), "class_id": F.lit(7), "a": F.lit(1), "bucket": F.lit(2)})
    assert cp.deduplicated(frame).count() == 1
