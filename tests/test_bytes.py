"""Texts handled as bytes give what expressions and plain Python give."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import arrowtext
from corpusmill.functions import text as X
from corpusmill.operators import chunking, dense, matching, sparse
from corpusmill.operators.embed import embed, hashing_embedder

PARTS = ["the ", "a", "B.", "é", "一二", "三。", " ", "\n", " \n\n", "9", "1,2:3", "İ", "　", "alpha. Beta", " beta! ", "’", "a'b’c", "\U0001f600", "!", "?",
         ". 一", ".\n4", "\x1c", "\x85", "\xa0", "\r\n", "٣.٤", "aaa bbb ccc ddd eee", "\t"]


def odd_texts(seed, n, longest=50):
    rng = random.Random(seed)
    return [None if rng.random() < 0.05 else "".join(rng.choice(PARTS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_strings_and_words_of_rows(monkeypatch):
    monkeypatch.setattr(arrowtext, "BYTES_AT_ONCE", 60)
    rng = random.Random(5)
    for seed in range(40):
        texts = odd_texts(seed, 9, 20)
        strings = [t[i : i + rng.randrange(1, 40)] for t in texts if t for i in (0, 2)] + ["alpha", "", "none", "é"]
        column = pa.array(["dropped", *texts], pa.string()).slice(1)
        rows, found = arrowtext.Holders(strings).rows(column)
        assert sorted(zip(rows, found)) == sorted({(i, s) for i, t in enumerate(texts) if t for s in strings if s and s in t})
        many, words = arrowtext.words(*arrowtext.utf8(column))
        plain = [re.findall("[a-z0-9]+", t or "") for t in texts]
        assert many.tolist() == [len(p) for p in plain] and words.to_pylist() == sum(plain, [])


def test_embedder_counts_every_word(spark):
    def plain(text):
        words = re.findall("[a-z0-9]+|[㐀-鿿]", (text or "").lower())
        return np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in words], minlength=64).tolist()

    texts = odd_texts(1, 60) + ["x" * 40 + " " + "x" * 41, "sixteenletterswd sixteenletterswde", "", *(f"w{i} w{i}" for i in range(400))]
    model, ascii_only = hashing_embedder(), [(t or "").encode("ascii", "ignore").decode() for t in texts]
    for part in (texts, ascii_only, ascii_only):
        assert model(part).tolist() == [plain(t) for t in part]
    assert model([]).shape == (0, 64)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", embed(F.col("t")).alias("e")).collect()
    assert all(r["e"] == plain(texts[r["i"]]) for r in rows)


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 2), (30, 0)])
def test_pieces_are_sentences_with_their_token_counts(spark, size, overlap):
    texts = odd_texts(size, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    plain = df.select("i", X.sentence_units("t").alias("s")).select("i", "s", F.transform("s", X.token_list).alias("tokens")).collect()
    got = {}
    for r in chunking.chunk(df, "t", size, count_tokens=True, strategy="dynamic", overlap_tokens=overlap).orderBy("i", "part").collect():
        got.setdefault(r["i"], []).append((r["content"], r["token_count"]))
    count = lambda s: len(chunking.TOKEN.findall(s))
    for r in plain:
        fit = []
        for sentence, tokens in zip(r["s"], r["tokens"]):
            assert chunking._token_counts([sentence]) == [len(tokens)]
            fit += [sentence] if len(tokens) <= size else ["".join(tokens[i : i + size]) for i in range(0, len(tokens), size)]
        spans = chunking._windows([count(s) for s in fit], size, overlap)[0]
        assert got.get(r["i"], []) == [("\n".join(fit[a:b]), sum(map(count, fit[a:b]))) for a, b in spans]


def test_words_asked_for_are_counted_in_the_texts(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts(3, 200))), "chunk_id long, content string")
    index, words = sparse.build_index(df, "content"), ["alpha", "beta", "一", "二三", "一二三", "9", "bbb"]
    rows = lambda index, words: sorted(map(str, sparse._of_vocabulary(index, words).collect()))
    for asked in (words, []):
        assert rows(index, asked) == rows(sparse.SparseIndex(index.vectors), asked)
    plan = sparse._of_vocabulary(index, words)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan  # no terms of all words


def test_containment_moves_pairs_and_no_texts(spark):
    texts = [(i // 2, t) for i, t in enumerate(odd_texts(8, 40))] + [(3, "abcdefghijklmnopqrstuvwxyz"), (None, "alpha")]
    terms = [(i // 2, t[2:22]) for i, t in enumerate(t for t in odd_texts(9, 20) if t)] + [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (4, "cdefghijklmnopqrstuvw"), (5, "cdefghijklmnopqrstuvx")]
    docs, names = spark.createDataFrame(texts, "d long, text string"), spark.createDataFrame(terms, "n int, name string")
    found = matching.contains_pairs(docs, names, "d", "text", "n", "name")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "strategy=broadcast" in plan
    held = lambda t, s: bool(t) and bool(s) and s in t
    heads = [(d, n) for d, t in texts for n, s in terms if held(t, (s or "")[:16])]
    want = [(d, n) for d, n in heads for e, t in texts if e == d and d is not None for m, s in terms if m == n and held(t, s)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and (3, 4) in want and (3, 5) not in want


def test_scores_below_the_best_so_far_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i // 2, rng.integers(0, 3, 4).tolist() if i % 5 else [float("nan")] * 4) for i in range(600)]
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "chunk_id long, embedding array<float>").repartition(2)
    asked = spark.createDataFrame([(i, [1.0, float(i), 0.0, 2.0]) for i in range(6)], "query_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {q: [] for q in range(6)}
        for r in dense.dense_search(asked, chunks, 9).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((round(r["score"], 8), r["chunk_id"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for q in range(6):
        scored = [(round(float(unit([1, q, 0, 2]) @ unit(v)), 9), i) for i, v in rows if v[0] == v[0]]
        assert got[q] == [(round(s, 8), i) for s, i in sorted(scored, key=lambda p: (-p[0], p[1]))[:9]]


def test_route_searches_once_and_moves_no_parents(spark, monkeypatch):
    from corpusmill.plans import retrieve

    units = [(str(i), f"f{i}.txt", 1, "t", "", f"Number {i} likes apples. And pears {i}. " * 4) for i in range(12)]
    df = spark.createDataFrame(units, "source_id string, filename string, unit_index int, title string, page string, content string")
    parents, children = chunking.parent_child(df, 30, 12)
    numbered = children.withColumn("chunk_id", F.col("source_id").cast("long") * 1000 + F.col("parent_index") * 10 + F.col("child_index"))
    made = retrieve.build_corpus(numbered, parents)
    names, plain = [], retrieve.stage_few
    monkeypatch.setattr(retrieve, "stage_few", lambda df, name: names.append(name) or plain(df, name))
    asked = spark.createDataFrame([(1, "Who likes pears 7?"), (2, "apples，比較以及差異 3?")], "query_id long, question string")
    out = retrieve.retrieve(asked, made, top_k=3)
    assert names == ["pool", "chosen"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi.*strategy=broadcast", plan)
    rows = out.orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in rows} == {1, 2} and all(r["content"] and r["id"] == r["parent_chunk_id"] for r in rows)
    assert rows[0]["source"] == "7"
