import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dense, expansion, fusion, keyword, matching, rerank, sparse

DOCS = [(0, "red apple pie"), (1, "yellow banana fruit fruit"), (2, "apple and banana are fruit")]


@pytest.fixture
def index(spark):
    df = spark.createDataFrame([(i, t, "even" if i % 2 == 0 else "odd") for i, t in DOCS], "chunk_id long, content string, source_id string")
    return sparse.build_index(df, "content", source_id="source_id")


def search(spark, index, text, k=5, **options):
    rows = sparse.bm25_search(spark.createDataFrame([(7, text)], "query_id long, text string"), index, k, **options).orderBy("rank").collect()
    return [(r["chunk_id"], round(r["score"], 6)) for r in rows]


def test_bm25_worked_example(spark, index):
    assert search(spark, index, "apple fruit") == [(2, 0.981218), (1, 0.626393), (0, 0.490609)]
    assert search(spark, index, "fruit fruit") == [(1, 1.060576), (2, 0.830674)]


def test_candidate_filter_keeps_global_statistics(spark, index):
    allowed = spark.createDataFrame([("odd",)], "source_id string")
    assert search(spark, index, "apple fruit", allowed=allowed) == [(1, 0.626393)]
    nothing = allowed.filter(F.lit(False))
    assert search(spark, index, "apple fruit", allowed=nothing) == []


def test_empty_chunks_count_in_the_statistics(spark):
    df = spark.createDataFrame([(0, "apple"), (1, ""), (2, "the of")], "chunk_id long, content string")
    stats = sparse.build_index(df, "content").statistics().first()
    assert (stats["n_chunks"], stats["avg_length"]) == (3, 1.0)


def test_matched_terms_follow_the_query(spark, index):
    q = spark.createDataFrame([(1, "fruit apple")], "query_id long, text string")
    rows = {r["chunk_id"]: r["matched_terms"] for r in sparse.bm25_search(q, index, 5, with_terms=True).collect()}
    assert rows[2] == ["fruit", "apple"] and rows[0] == ["apple"]


def test_salted_path_equals_broadcast_path(spark, index, monkeypatch):
    expected = search(spark, index, "apple fruit banana")
    monkeypatch.setattr(sparse, "fits_broadcast", lambda *_: False)
    assert search(spark, index, "apple fruit banana") == expected


def vectors(spark, n, name, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_dense_search_and_grid_agree_with_numpy(spark, monkeypatch):
    q_rows, q = vectors(spark, 5, "query_id", 1)
    c_rows, c = vectors(spark, 60, "chunk_id", 2)
    unit = lambda v: np.asarray(v, dtype=np.float32).astype(float) / np.linalg.norm(np.asarray(v, dtype=np.float32).astype(float))
    want = {}
    for qid, v in q_rows:
        scores = sorted(((-round(float(unit(v) @ unit(w)), 9), cid) for cid, w in c_rows))[:4]
        want[qid] = [cid for _, cid in scores]

    def got():
        out = {}
        for r in dense.dense_search(q, c, 4).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["chunk_id"])
        return out

    assert got() == want
    monkeypatch.setattr(dense, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(dense, "ROWS_PER_CELL", 17)
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", 2)
    assert got() == want


def ranked(spark, ids, branch, list_no):
    rows = [(1, i, r, 1.0 / r) for r, i in enumerate(ids, 1)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")
    return fusion.as_list(hits, list_no, branch)


def test_weighted_rrf_worked_example(spark):
    lists = ranked(spark, ["A", "B", "C"], "bm25", 0).unionByName(ranked(spark, ["C", "A", "D"], "embedding", 1))
    rows = fusion.weighted_rrf(lists).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["fusion_score"], 8)) for r in rows] == [("A", 0.01628768), ("C", 0.01608119), ("B", 0.00967742), ("D", 0.00634921)]


def test_rrf_ties_keep_insertion_order(spark):
    lists = ranked(spark, ["B"], "bm25", 0).unionByName(ranked(spark, ["A"], "bm25", 1))
    assert [r["chunk_id"] for r in fusion.weighted_rrf(lists).orderBy("rank").collect()] == ["B", "A"]


def test_rank_map(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 2.0, 4.0, 4.0)] + [(2, 3.0), (3, 0.0)], "q int, v double")
    rows = df.select("q", "v", fusion.rank_map(F.col("v"), "q").alias("m")).collect()
    got = sorted((r["q"], r["v"], round(r["m"], 4)) for r in rows)
    assert got == [(1, 0.0, 0.0), (1, 2.0, 0.3333), (1, 4.0, 0.8333), (1, 4.0, 0.8333), (2, 3.0, 1.0), (3, 0.0, 0.0)]


def test_normalize_weights():
    assert fusion.normalize_weights(0, 0) == (0.5, 0.5) and fusion.normalize_weights(-1, 2) == (0.0, 1.0)


def test_feature_rerank_prefers_better_coverage(spark):
    rows = [(1, 0, 0.02, 2.0, 0.5, "apple pie", "apple pie now", 1), (1, 1, 0.02, 2.0, 0.5, "apple pie", "only apple", 2)]
    pool = spark.createDataFrame(
        rows, "query_id long, chunk_id long, fusion_score double, bm25_score double, embedding_score double, query_text string, chunk_text string, rank int"
    )
    out = rerank.feature_rerank(pool, 2).orderBy("rerank_rank").collect()
    assert [r["chunk_id"] for r in out] == [0, 1] and out[0]["coverage"] == 1.0
    assert math.isclose(out[0]["rerank_score"] - out[1]["rerank_score"], 0.05 + 0.02)


def test_attention_order(spark):
    ranks = spark.range(1, 7).orderBy(rerank.attention_order(F.col("id"))).collect()
    assert [r["id"] for r in ranks] == [1, 3, 5, 6, 4, 2]


def test_contains_pairs_against_brute_force(spark):
    texts = [(1, "the quick brown fox jumps over"), (2, "勞工請假規則第十條"), (3, "")]
    terms = [(10, "quick brown fox jumps ov"), (11, "fox"), (12, "請假規則"), (13, "missing"), (14, "x")]
    got = matching.contains_pairs(
        spark.createDataFrame(texts, "tid int, t string"), spark.createDataFrame(terms, "kid int, k string"), "tid", "t", "kid", "k"
    )
    assert {tuple(r) for r in got.collect()} == {(t, k) for t, text in texts for k, term in terms if term in text}


def brute_keyword(query, text):
    words = [w.lower() for w in __import__("re").findall(r"[A-Za-z0-9_,.]+", query)] + __import__("re").findall(r"[一-鿿]{2,}", query)
    own = [w.lower() for w in __import__("re").findall(r"[A-Za-z0-9_,.]+", text)] + __import__("re").findall(r"[一-鿿]{2,}", text)
    q, c = "".join(query.split()), "".join(text.split())
    score = sum(3 if w in own else (1 if w in c else 0) for w in words)
    return score + sum(n for n in (4, 3, 2) for i in range(len(q) - n + 1) if q[i : i + n] in c)


def test_keyword_search_both_paths(spark, monkeypatch):
    queries = [(1, "apple pie recipe"), (2, "勞工請假 apple")]
    chunks = [(5, "An Apple pie and more apples"), (6, "勞工請假規則"), (7, "zzz")]
    want = {(q, c, float(brute_keyword(qt, ct))) for q, qt in queries for c, ct in chunks if brute_keyword(qt, ct) > 0}
    q = spark.createDataFrame(queries, "query_id long, text string")
    c = spark.createDataFrame(chunks, "chunk_id long, content string")
    got = lambda: {(r["query_id"], r["chunk_id"], r["score"]) for r in keyword.keyword_search(q, c, 5).collect()}
    assert got() == want
    monkeypatch.setattr(keyword, "fits_broadcast", lambda *_: False)
    assert got() == want


def test_definition_search(spark):
    chunks = spark.createDataFrame(
        [(1, "", "", "甲粒子，又稱為小球"), (2, "", "", "甲粒子" + "字" * 120 + "又稱"), (3, "", "", "乙的定義")],
        "chunk_id long, parent_title string, title string, content string",
    )
    rows = keyword.definition_search(spark.createDataFrame([(9, "甲粒子")], "query_id long, subject string"), chunks, 5).collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [(1, 8 + 10 + 10 + 1.0)]


def test_expand_parents_first_seen(spark):
    picked = spark.createDataFrame(
        [(1, 1, "c1", "p1", "t", "x"), (1, 2, "c2", "p1", "t", "y"), (1, 3, "c3", "gone", "t", "z")],
        "query_id int, rank int, child_id string, parent_id string, title string, content string",
    )
    parents = spark.createDataFrame([("p1", "whole", "P", "1")], "parent_id string, content string, title string, page string")
    rows = expansion.expand_parents(picked, parents, 5).orderBy("context_rank").collect()
    assert [(r["context_id"], r["context_content"]) for r in rows] == [("p1", "whole"), ("c3", "z")]


def test_near_copies_are_dropped(spark):
    units = spark.createDataFrame(
        [(1, 0, 3.0, "abc def"), (1, 1, 2.0, "abcdef"), (1, 2, 1.0, "abcdefg"), (1, 3, 0.5, "other text")], "query_id int, unit_index int, score double, content string"
    )
    assert [r["unit_index"] for r in expansion.drop_near_copies(units, 4).orderBy("position").collect()] == [0, 3]


def test_anchor_preservation(spark):
    fused = spark.createDataFrame([(1, c, s, r) for r, (c, s) in enumerate([("a", 0.9), ("b", 0.8), ("k", 0.1)], 1)], "query_id int, chunk_id string, score double, rank int")
    words = spark.createDataFrame([(1, "k", 20.0, 1), (1, "a", 15.0, 2)], "query_id int, chunk_id string, keyword_score double, keyword_rank int")
    rows = expansion.preserve_anchors(fused, words, 2).orderBy("position").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "k"]


def test_counter_is_the_model_of_term_counts():
    assert Counter("aab") == {"a": 2, "b": 1}
