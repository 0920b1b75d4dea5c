"""Fingerprints, links and classes against brute force over all pairs."""

import numpy as np
import pytest
import xxhash
from llm_cases import ODD_SCHEMA, SMALL

from loglantern.llm import pivots


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """The set of items connected to each, by plain search."""
    found = {}
    for item in items:
        if item in found:
            continue
        group, open_items = {item}, [item]
        while open_items:
            here = open_items.pop()
            for other in items:
                if other not in group and linked(here, other):
                    group.add(other)
                    open_items.append(other)
        found |= dict.fromkeys(group, frozenset(group))
    return found


def near(a, b):
    return (a ^ b).bit_count() <= 3


def plain_classes(rows):
    prints = {}
    for row in rows:
        prints.setdefault(plain_print(row["text"]), []).append(row["doc_id"])
    group = classes(list(prints), near)
    least = {}
    for own, others in group.items():
        ids = [i for p in others for i in prints[p] if i is not None]
        least[own] = min(ids) if ids else None
    return sorted(((r["doc_id"], plain_print(r["text"]), least[plain_print(r["text"])]) for r in rows), key=repr)


def spark_classes(docs):
    rows = pivots.near_duplicates(docs).collect()
    return sorted(((r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in rows), key=repr)


def test_documents_like_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spark_classes(docs) == plain_classes(docs.collect())


def test_odd_documents(spark, odd_documents):
    assert spark_classes(odd_documents) == plain_classes(odd_documents.collect())


def test_no_documents(no_documents):
    assert pivots.near_duplicates(no_documents).collect() == []


def test_only_ascii_letters_and_blanks_count(spark):
    texts = ["Éa B C d\x0be", "Éa b c d e", "éa b c d e", "x\x00y z", "\x1f"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None, None, None) for i, t in enumerate(texts)], ODD_SCHEMA)
    found = spark_classes(docs)
    assert found == plain_classes(docs.collect())
    assert found[0][1] == found[1][1] != found[2][1]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = b" ".join(str(n % 71 * (n % 13)).encode() for n in range(5000))
    whole = pivots.fingerprints([text, None, b"one two", text])
    monkeypatch.setattr(pivots, "PIECE", 64)
    assert list(pivots.fingerprints([text, None, b"one two", text])) == list(whole)
    assert int(whole[0]) == plain_print(text.decode()) and whole[1] == 0


def scattered(count, seed=5):
    """Prints around a few centres, many of them at distances around the radius."""
    random = np.random.default_rng(seed)
    centres = [int(c) for c in random.integers(0, 1 << 63, 6)]
    made = set(centres)
    while len(made) < count:
        bits = random.choice(64, random.integers(1, 6), replace=False)
        made.add(centres[random.integers(0, 6)] ^ sum(1 << int(b) for b in bits))
    return sorted(made)


@pytest.mark.parametrize("limit", [1, 8, 4096])
def test_links_connect_what_brute_force_connects(spark, limit):
    prints = scattered(500)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = pivots.links(spark.createDataFrame(signed, "print bigint"), limit).collect()
    ties = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in found}
    assert classes(prints, lambda a, b: frozenset((a, b)) in ties) == classes(prints, near)


def test_every_near_pair_shares_bands_of_the_table():
    random = np.random.default_rng(1)
    to = pivots.references()
    one = random.integers(0, 1 << 63, 2000).astype(np.uint64)
    two = one.copy()
    for column in random.integers(0, 64, (3, 2000)):
        two ^= np.uint64(1) << column.astype(np.uint64)
    equal = sum((pivots.within(one, band, to) == pivots.within(two, band, to)).all(axis=1).astype(int) for band in pivots.bands(0))
    assert (equal >= pivots.SHARED).all()
    assert (np.abs(pivots.distances(one, to) - pivots.distances(two, to)).max(axis=1) <= 3).all()


def test_the_table_discards_nearly_all_other_pairs():
    random = np.random.default_rng(2)
    table = pivots.distances(random.integers(0, 1 << 63, 3000).astype(np.uint64), pivots.references())
    left = np.abs(table[:-1] - table[1:]).max(axis=1) <= pivots.RADIUS
    assert left.mean() < 0.01
