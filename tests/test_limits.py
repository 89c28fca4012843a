"""Inputs above the sizes that were once cut, odd white space, and ids of any kind."""

import json

from pyspark.sql import functions as F

from corpusmill.operators import chunking, dense, expansion, keyword, planning, quality, rerank
from corpusmill.plans import retrieve
from corpusmill.config import Settings
from corpusmill.sources import documents


def test_every_file_yields_a_unit_or_a_warning(spark, tmp_path):
    for name, data in (("a.txt", b"text"), ("b.pdf", b"%PDF-1.4"), ("c.png", b"\x89PNG"), ("d.xyz", b"?")):
        (tmp_path / name).write_bytes(data)
    files = documents.read_files(spark, str(tmp_path))
    units, warnings = documents.extract_units(files)
    named = {r["filename"] for r in units.collect()} | {r["filename"] for r in warnings.collect()}
    assert named == {r["filename"] for r in files.collect()} and len(named) == 4


def test_deep_and_wide_json_is_read(spark):
    deep = json.dumps({"a": 1})
    for _ in range(60):
        deep = '{"k": ' + deep + "}"
    wide = json.dumps({"x": list(range(120_000))})
    df = spark.createDataFrame([(deep,), (wide,)], "text string").select(F.explode(documents.json_sections("text")).alias("u"))
    rows = df.select("u.title", F.length("u.content").alias("n"), "u.warning").collect()
    assert all(r["warning"] is None for r in rows) and max(r["n"] for r in rows) > 1_000_000


def test_all_claims_are_read_whole(spark):
    answer = "\n".join(f"claim {n} " + "x" * 900 + " [1]" for n in range(60))
    (row,) = spark.createDataFrame([(answer,)], "a string").select(quality.claims(F.col("a")).alias("c")).collect()
    assert len(row["c"]) == 60 and all(len(c["claim"]) > 900 for c in row["c"])
    (row,) = spark.createDataFrame([("\n".join(f"plain {n} " + "y" * 600 for n in range(30)),)], "a string").select(quality.uncited_claims(F.col("a")).alias("c")).collect()
    assert len(row["c"]) == 30 and len(row["c"][0]) > 600


def test_contexts_and_terms_are_not_cut(spark):
    rows = [(1, n, "z" * 4000) for n in range(1, 21)]
    kept = expansion.normalize_contexts(spark.createDataFrame(rows, "query_id long, rank int, content string")).collect()
    assert len(kept) == 20 and len(kept[0]["content"]) == 4000
    (row,) = spark.createDataFrame([(" ".join(f"term{n}" for n in range(70)),)], "q string").select(rerank.rerank_terms(F.col("q")).alias("t")).collect()
    assert len(row["t"]) == 70
    (row,) = spark.createDataFrame([("勞工請假", "勞工請假" + "x" * 900)], "q string, r string").select(planning.sanitize_rewrite(F.col("q"), F.col("r")).alias("t")).collect()
    assert len(row["t"]) == 904


def test_front_matter_reaches_the_first_heading(spark):
    text = "\n".join([*(f"line {n}" for n in range(30)), "第一章 開始", "body"])
    rows = chunking.narrative_sections(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").collect()
    assert "line 29" in next(r["content"] for r in rows if r["line_no"] == 0)


def test_limits_of_the_caller_are_kept():
    assert retrieve._clamp_k(Settings().normalized(), 50, 400) == (50, 400)


def test_dense_search_keeps_id_types_and_large_ids(spark):
    big = 2**61 + 3
    queries = spark.createDataFrame([(big, [1.0, 0.0]), (big + 1, [0.0, 1.0])], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dense.dense_search(queries, chunks, 2).collect())
    assert got == [(big, 1, "a"), (big, 2, "b"), (big + 1, 1, "c"), (big + 1, 2, "a")]
    old = dense.fits_broadcast
    dense.fits_broadcast = lambda df: False
    try:
        assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in dense.dense_search(queries, chunks, 2).collect()) == got
    finally:
        dense.fits_broadcast = old


def test_both_keyword_paths_agree_on_odd_text(spark):
    queries = spark.createDataFrame([(1, "red apple pie"), (2, "勞工請假 form")], "query_id long, text string")
    chunks = spark.createDataFrame([("x", "red\u001capple pie"), ("y", "red　apple pie"), ("z", "勞工\u001f請假 form"), ("w", None)], "chunk_id string, content string")
    fast = sorted(map(tuple, keyword.keyword_search(queries, chunks, 5).collect()))
    old = keyword.fits_broadcast
    keyword.fits_broadcast = lambda df: False
    try:
        assert sorted(map(tuple, keyword.keyword_search(queries, chunks, 5).collect())) == fast and fast
    finally:
        keyword.fits_broadcast = old
