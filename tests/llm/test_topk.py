import math

import numpy as np
import pytest

from unitloom.llm.topk import ImpactIndex, quantised, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, k):
    ok = sorted({
        (r[0], tuple(math.floor(1024 * float(np.float32(x))) for x in r[1]))
        for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
    })
    out = []
    for i, q in ok:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **more):
    df = quantised(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA))
    return sorted(map(tuple, top_k(df, df.filter("vec_id % 100 = 0"), **more).collect()))


@pytest.mark.parametrize("more", [{}, {"shard": 100, "query_block": 3}])
def test_best_rows_equal_brute_force(spark, more):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((900, 12)) * 0.3
    base[300:500] = base[:200] + 0.01 * rng.standard_normal((200, 12))
    base[500:600] = base[3]
    base[600:650] = np.abs(base[600:650])
    base[700:750] = -np.abs(base[700:750])
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(base)]
    rows += [(1000, [0.0] * 12, 1), (1100, None, 1), (1200, [float("nan")] * 12, 1), (1300, [1.0] * 5, 1), (1301, [2.0] * 5, 1), (1400, [None] * 12, 1)]
    rows += [(None, [1.0] * 12, 1), (1500, [], 1), (1600, [float("inf")] * 12, 1), rows[0]]
    assert run(spark, rows, **more) == brute(rows, 10)


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [0.5], 1)]) == []
    assert run(spark, [(100, [0.5], 1), (7, [-0.5], 1), (5, [-0.5], 1)]) == [(100, 1, 5, -262144), (100, 2, 7, -262144)]


def test_search_stops_before_the_end_with_the_exact_result():
    rng = np.random.default_rng(2)
    vectors = np.floor(rng.standard_normal((4000, 32)) * 180).astype(np.int64)
    vectors[50:70] = vectors[7] + rng.integers(-5, 5, (20, 32))
    index = ImpactIndex(np.arange(4000), vectors)
    for q in (7, 60, 500):
        scores = vectors @ vectors[q]
        scores[q] = -(10**15)
        want = np.lexsort((np.arange(4000), -scores))[:10]
        ids, found = index.best(vectors[q], 10, q)
        assert ids.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
