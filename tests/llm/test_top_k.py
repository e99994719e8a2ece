"""Exact top-k on odd vectors; the whole table is compared with SQL."""

import math
import random

import pytest

from riskframe.llm import top_k as K


def plain(rows, query_ids, k):
    fine = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in fine if i in query_ids}):
        best = {}
        for a, va in fine:
            for b, vb in fine:
                if a == q and b != q and len(va) == len(vb):
                    s = sum(x * y for x, y in zip(va, vb))
                    best[b] = max(s, best.get(b, s))
        for rank, (s, b) in enumerate(sorted(((s, b) for b, s in best.items()), key=lambda x: (-x[0], x[1]))[:k], 1):
            out.append((q, rank, b, s))
    return out


def run(spark, rows, query_ids, k, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS id", "3 AS v")
    found = K.top_k(frame, frame.filter(frame.vec_id.isin(query_ids)), k=k, **more)
    return sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))


def test_odd_vectors_and_ties(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(5)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [3.0, -2.0])]
    rows += [(None, [9.0] * 5), (7, rows[7][1]), (8, [0.25] * 5), *[(300 + i, [1.0] * 5) for i in range(40)]]
    ids = [0, 7, 8, 100, 200, 202, 205, 300]
    assert run(spark, rows, ids, 10) == plain(rows, ids, 10)
    assert run(spark, rows[:4], [0, 1], 10) == plain(rows[:4], [0, 1], 10)


def test_clustered_vectors_are_pruned_exactly(spark):
    rng = random.Random(4)
    rows = [(i, [10.0 * (i % 8) + rng.random(), 3.0 * (i % 3) + rng.random(), rng.random()]) for i in range(600)]
    ids = list(range(0, 600, 50))
    assert run(spark, rows, ids, 5, annuli=6) == plain(rows, ids, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**18 + i), float(2**18 - 3 * i)]) for i in range(30)]
    assert run(spark, rows, [0, 5], 4) == plain(rows, [0, 5], 4)


def test_nothing_to_search(spark):
    assert run(spark, [(1, None)], [1], 3) == []
    assert run(spark, [(1, [1.0])], [1], 3) == []


def test_huge_components_do_not_saturate(spark):
    rows = [(0, [2.0**54, 1.0]), (1, [2.0**-12, 3.0]), (2, [0.0, 2.0**-10]), (3, [0.0, -0.25])]
    assert run(spark, rows, [1, 2, 3], 3) == plain(rows, [1, 2, 3], 3)


@pytest.mark.parametrize("big", [2.0**45, 1e300])
def test_scores_beyond_a_long_raise(spark, big):
    with pytest.raises(Exception, match="Overflow|too large|too big|infinity"):
        run(spark, [(0, [big, big]), (1, [big, big])], [0], 3)
