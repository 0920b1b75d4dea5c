"""The manifest against one built by plain loops, over several storeys, odd documents and tampered leaves."""

from hashlib import sha256

import pytest
from llm_cases import ODD_SCHEMA, SMALL
from pyspark.sql import functions as F

from loglantern.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    fields = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        path.append((at % 2 == 1, level[at ^ 1] if at ^ 1 < len(level) else None))
        at //= 2
    return path


def plain_proofs(rows):
    groups = {}
    for row in rows:
        groups.setdefault("" if row["lang"] is None else "=" + row["lang"], []).append(row)
    order = sorted(groups, key=str.encode)
    trees = {}
    for group in order:
        mine = sorted(groups[group], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[group] = mine, plain_levels([plain_leaf(r) for r in mine])
    top = plain_levels([trees[g][1][-1][0] for g in order])
    found = []
    for rank, group in enumerate(order):
        mine, levels = trees[group]
        for at, row in enumerate(mine):
            path = plain_path(levels, at) + plain_path(top, rank)
            found.append((row["doc_id"], plain_leaf(row), levels[-1][0], top[-1][0], path))
    return found


def by_leaf(found):
    return sorted(found, key=repr)


def spark_proofs(docs):
    rows = merkle.proofs(merkle.manifest(merkle.leaves(docs))).collect()
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["hash"]) for s in r["proof"]]) for r in rows]


@pytest.fixture
def low_storeys(monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "PART", 3)


@pytest.mark.parametrize("low", [False, True])
def test_proofs_are_those_of_plain_loops(spark, request, low):
    if low:
        request.getfixturevalue("low_storeys")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert by_leaf(spark_proofs(docs)) == by_leaf(plain_proofs(docs.collect()))


def test_odd_documents_have_proofs(spark, odd_documents, low_storeys):
    found = spark_proofs(odd_documents)
    expected = plain_proofs(odd_documents.collect())
    assert by_leaf(found) == by_leaf(expected)


def test_many_languages_of_one_document_each(spark, low_storeys):
    rows = [(i, f"text {i}", f"l{i % 41}" if i % 5 else None, "a", i, None, None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    assert by_leaf(spark_proofs(docs)) == by_leaf(plain_proofs(docs.collect()))


def test_a_single_document_is_the_root(spark):
    docs = spark.createDataFrame([(1, "x", "en", "a", 1, None, None, None, None)], ODD_SCHEMA)
    ((_, leaf, subroot, root, proof),) = spark_proofs(docs)
    assert leaf == subroot == root and proof == []


def test_no_documents_have_no_root(no_documents):
    made = merkle.manifest(merkle.leaves(no_documents))
    assert made.root is None and merkle.proofs(made).collect() == []


def test_only_tampered_leaves_miss_the_root(spark, odd_documents):
    changed = F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("else").cast("binary"), 256))
    found = merkle.proofs(merkle.manifest(merkle.leaves(odd_documents, tampered=changed)))
    reached = found.select("doc_id", "root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("to")).collect()
    assert reached
    for row in reached:
        assert (row["root"] == row["to"]) == (row["doc_id"] is None or row["doc_id"] % 2 == 1)


def test_as_few_nodes_are_fetched_as_can_be():
    for n in range(1, 40):
        for known in ({0}, {n - 1}, set(range(n // 3, n // 2 + 1)), set(range(n))):
            asked = merkle.missing(set(known), n)
            # neither a known leaf nor anything below an asked node or above a known one is asked for
            ancestors = {(level, i >> level) for i in known for level in range(merkle.height(n) + 1)}
            assert len(asked) == len(set(asked)) and not set(asked) & ancestors
            assert all((level, i ^ 1) in ancestors for level, i in asked)
            fetched = {(level, i): str((level, i)) for level, i in asked}
            merkle.derived({i: str(i) for i in known}, n, fetched)


def test_a_hot_language_is_spread_over_leaf_partitions(spark, low_storeys):
    rows = [(i, "same", "en", "a", 1, None, None, None, None) for i in range(64)]
    made = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, ODD_SCHEMA)))
    asked = merkle.wanted(made.groups).groupBy("part").count().collect()
    assert len(asked) == 8 and all(r["count"] <= 4 for r in asked)
