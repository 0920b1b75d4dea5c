import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.llm import kdtree


def within(score):
    return min(max(score, 1 - 2**63), 2**63 - 1)


def brute(rows, k, asked):
    whole = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) if abs(x) < 2**50 else 256 * int(x) for x in v])
    out = []
    for q in sorted(whole):
        if asked(q):
            hits = set()
            for qv in whole[q]:
                hits |= {(-within(sum(a * b for a, b in zip(qv, v, strict=True))), i, n) for i, vs in whole.items() if i != q for n, v in enumerate(vs) if len(v) == len(qv)}
            out += [(q, rank, i, -s) for rank, (s, i, _) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_rows, block_rows", [(4096, 256), (50, 3)])
def test_the_best_are_those_of_a_full_search(spark, shard_rows, block_rows):
    pick = random.Random(4)
    rows = [(n, [pick.gauss(0, 1) for _ in range(6)]) for n in range(400)]
    rows += [(1000 + n, [0.5] * 6) for n in range(150)]  # ties
    rows += [(2000, None), (2010, []), (2020, [None] * 6), (2030, [float("nan")] * 6), (2040, [float("inf")] * 6)]
    rows += [(3000 + n, [1.0, 2.0]) for n in range(3)] + [(4000, [0.0] * 6), (4010, [-3.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"shard": F.lit(1), "rank": F.lit(2)})
    found = kdtree.top_k(frame, F.col("vec_id") % 10 == 0, 5, shard_rows, block_rows).collect()
    assert sorted(map(tuple, found)) == brute(rows, 5, lambda q: q % 10 == 0)


@pytest.mark.parametrize("powers", [(8, 30), (20, 40), (0, 1015)])
def test_components_of_any_size(spark, powers):
    pick = random.Random(6)
    rows = [(n, [pick.choice((-1, 1)) * pick.random() * 2.0 ** pick.randint(*powers) for _ in range(4)]) for n in range(200)]
    rows += [(300 + n, [pick.gauss(0, 1) for _ in range(4)]) for n in range(200)] + [(n, [-1.7e308, 70000.0, 0.0, -1e-300]) for n in (600, 601)] + [(610, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, kdtree.top_k(frame, F.col("vec_id") % 10 == 0, 5, 100, 7).collect()))
    assert found == brute(rows, 5, lambda q: q % 10 == 0)


def test_rows_of_one_id_lie_in_many_shards(spark):
    rows = [(7, [float(n % 5), 1.0]) for n in range(300)] + [(n, [0.25, float(n % 3)]) for n in range(100, 200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, kdtree.top_k(frame, F.col("vec_id").isin(7, 150), 3, 40, 5).collect()))
    assert found == brute(rows, 3, lambda q: q in (7, 150))


def test_repeated_and_empty_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.1, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, kdtree.top_k(frame, F.col("vec_id") == 0).collect()))
    assert found == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 6400)]
    assert kdtree.top_k(frame.where("false"), F.lit(True)).count() == 0
    assert kdtree.top_k(frame.limit(1), F.lit(True)).count() == 0


def test_boxes_bound_all_that_they_hold():
    pick = np.random.default_rng(5)
    points = pick.integers(-300, 300, (500, 8))
    tree = kdtree.Tree(np.arange(500), points, leaf=16)
    queries = pick.integers(-300, 300, (20, 8))
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.spans):
        if not tree.kids[node]:
            assert (bounds[:, node] >= (queries @ tree.points[a:b].T).max(axis=1)).all()
    assert sorted(tree.ids.tolist()) == list(range(500))
