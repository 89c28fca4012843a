"""Searches whose shuffles and tables do not grow with the postings."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import sparse


def test_lexical_search_keeps_one_row_per_chunk(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 90, f"s{i % 4}", " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(40)))) for i in range(90)]
    index = sparse.build_index(spark.createDataFrame(rows, "chunk_id long, source_id string, content string"), "content", source_id="source_id")
    asked = spark.createDataFrame([(q, v, f"w{q} w{v} w{q} w11 none") for q in range(5) for v in range(3)], "query_id long, variant int, text string")
    allowed = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    tables, plain = {}, sparse.stage
    monkeypatch.setattr(sparse, "stage", lambda df, name: tables.setdefault(name, plain(df, name)))
    monkeypatch.setattr(sparse, "PAIRS_AT_ONCE", 50)

    def hits(**options):
        tables.clear()
        found = sparse.bm25_search(asked, index, 4, keys=("query_id", "variant"), with_terms=True, **options).collect()
        return sorted((r["query_id"], r["variant"], r["rank"], r["chunk_id"], r["source_id"], tuple(r["matched_terms"]), round(r["score"], 8)) for r in found)

    here = hits(), hits(allowed=allowed)
    assert tables["kept"].count() == len(rows)
    monkeypatch.setattr(sparse, "fits_broadcast", lambda *_: False)
    assert here == (hits(), hits(allowed=allowed))


def test_records_of_one_name_count_when_they_match(spark, tmp_path):
    from corpusmill.plans import registry

    registry.load_all()
    items = [(3, "red apple pear tail"), (7, "red apple plum tail"), (9, "blue stone moss tail")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Two turns have the number 200; only the first one has all words of a name.
    turns = [(1, 0, "a plum"), (2, 0, "apple and red"), (1, 100, "apple and red"), (4, 0, "stone"), (4, 0, "blue")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = registry.QUERIES["alias_expansion"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(100, 1, 7), (200, 1, 3)]


def test_open_entities_of_pages_stay(spark):
    from corpusmill.sources.documents import html_text

    df = spark.createDataFrame([("x &amp{a} &amp; &amp;lt; &copy;\n &quot y",)], "h string")
    row = df.select(html_text(F.col("h"), closed=True).alias("c"), html_text(F.col("h")).alias("o")).first()
    assert row["c"] == "x &amp{a} & &lt; ©\n&quot y" and row["o"] == 'x &{a} & &lt; ©\n" y'


def test_equal_texts_are_embedded_once_without_sorting_texts(spark, tmp_path):
    from corpusmill.operators.vectorstore import VectorStore, _first_of_digest, digest

    texts = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)] + [(40, None), (41, "")], "chunk_id long, content string")
    store = VectorStore(spark, str(tmp_path))
    assert store.add(texts) == 6 and store.add(texts) == 0
    assert store.embedded(texts).where("embedding IS NOT NULL").count() == 42
    plan = texts.select(digest("content").alias("digest"), "content").repartition("digest").mapInArrow(_first_of_digest, "digest string, text string")
    assert "Sort" not in plan._jdf.queryExecution().executedPlan().toString()


def test_whole_route_writes_chunks_and_parents_only(spark, tmp_path, monkeypatch):
    from corpusmill.plans import hybrid_queries

    kinds = []
    monkeypatch.setattr(hybrid_queries, "folder", lambda spark, kind, name: kinds.append(kind) or f"{tmp_path}/{kind}")
    rows = [(i, f"word{i} stands. " * 90, "en", "s1") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = hybrid_queries.corpus(spark, str(tmp_path))
    assert sorted(kinds) == ["chunks", "parents"]
    assert made.chunks.join(made.parents, "parent_id", "left_semi").count() == made.chunks.count() == made.index.vectors.count() > 3


def test_substrings_are_found_from_all_positions_at_once(spark, monkeypatch):
    from corpusmill.operators import keyword

    rng = random.Random(5)
    word = lambda signs, most: "".join(rng.choice(signs) for _ in range(rng.randrange(1, most)))
    strings = list(dict.fromkeys([word("abßc文", 7) for _ in range(80)]))
    texts = ["", "a", "x" * 9, *[word("abßc文X\U0001f600\0", 60) for _ in range(60)]]
    want = [[s in t for s in strings] for t in texts]
    assert keyword._Substrings(strings).found(texts).tolist() == want
    monkeypatch.setattr(keyword, "TABLE_CELLS", 0)
    assert keyword._Substrings(strings).found(texts).tolist() == want
    assert keyword._Substrings([]).found(["a"]).shape == (1, 0)
    monkeypatch.setattr(keyword, "CHARS_AT_ONCE", 10)
    assert list(keyword._cuts([4, 4, 4, 99, 1], 2)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    monkeypatch.setattr(keyword, "CELLS_AT_ONCE", 3)
    asked = spark.createDataFrame([(1, "red Apple pie"), (2, "文文 pie_2, ap"), (3, "")], "query_id long, text string")
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(["red", "Apple", "pie_2,", "applepie", "文文", "p"]) for _ in range(6))) for i in range(30)] + [(99, None)], "chunk_id long, content string")
    here = keyword.keyword_search(asked, chunks, 7).collect()
    monkeypatch.setattr(keyword, "fits_broadcast", lambda *_: False)
    assert sorted(here) == sorted(keyword.keyword_search(asked, chunks, 7).collect()) and here


def test_blocks_are_made_where_their_chunks_lie():
    import pyarrow as pa

    from corpusmill.operators import postings

    columns = {"window": pa.array([4, 4, 5], pa.int64()), "slot": pa.array([0, 1, 0], pa.int32()), "length": pa.array([3, 2, 1], pa.int32())}
    columns |= {"names": pa.array([["a", "b"], ["b"], []], pa.list_(pa.string())), "tfs": pa.array([[1, 2], [5], []], pa.list_(pa.int32()))}
    made = pa.Table.from_batches(postings._blocks_of([pa.RecordBatch.from_pydict(columns)])).to_pylist()
    entry = lambda slot, tf, length: {"slot": slot, "tf": tf, "length": length}
    block = lambda term, n, most, short, *entries: {"term": term, "window": 4, "n": n, "max_tf": most, "min_length": short, "entries": list(entries)}
    assert made == [block("a", 1, 1, 3, entry(0, 1, 3)), block("b", 2, 5, 2, entry(0, 2, 3), entry(1, 5, 2))]
