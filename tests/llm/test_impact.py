"""Exact top k against brute force."""

import math
import random

import numpy as np

from corpusmill.llm import impact as I

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok if c != q and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(n, [rng.gauss(0, 0.3) for _ in range(8)]) for n in range(300)]
    rows += [(1000 + n, rows[7][1]) for n in range(40)]  # ties
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 4), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, [0.1] * 8), (2250, [0.5, 0.5]), (2300, [0.0] * 8), (2301, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    for block, batch in ((16384, 256), (37, 3)):
        got = sorted(tuple(r) for r in I.top_products(df, k=5, block_rows=block, query_rows=batch).collect())
        assert got == brute(rows, 5, 50)


def test_stops_only_on_proof():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-200, 200, (3000, 6))
    vectors[:5] = 250  # a clear top: most segments need not be read
    index = I.ImpactIndex(vectors)
    for query in (np.full(6, 200), rng.integers(-200, 200, 6), np.zeros(6, int)):
        rows, scores = index.members(query, 5, np.zeros(3000, bool))
        exact = vectors @ query
        assert sorted(scores)[-5:] == sorted(exact)[-5:] and (scores == exact[rows]).all()
        assert set(np.flatnonzero(exact >= np.sort(exact)[-5])) <= set(rows)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "x")], SCHEMA)
    assert [tuple(r) for r in I.top_products(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert I.top_products(spark.createDataFrame([], SCHEMA)).count() == 0
