"""Whole retrieval routes over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking, keyword, metrics
from corpusmill.plans import ask, retrieve
from corpusmill.plans.answer_queries import gold_pairs
from corpusmill.plans.chunk_queries import PIECES_SQL, pieces, units
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import dense_hits, questions
from corpusmill.plans.stores import files_digest, folder, kept
from corpusmill.session import WIDE_READ_ROWS, read_table, wide_rows

KEYWORD_SQL = f"""{PIECES_SQL},
    kc AS (SELECT doc_id AS chunk_id, regexp_replace(text, '\\s+', '', 'g') AS dense, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_,.]+'), lambda x: lower(x))) AS own FROM pc),
    qd AS (SELECT item_id AS query_id, regexp_replace(text, '\\s+', '', 'g') AS q, list_transform(regexp_extract_all(text, '[A-Za-z0-9_,.]+'), lambda x: lower(x)) AS words FROM benchmark),
    qg AS (SELECT query_id, g, sum(length(g)) AS points FROM (SELECT query_id, unnest(list_transform(range(1, greatest(length(q) - 2, 1)), lambda i: substr(q, i, 4)) || list_transform(range(1, greatest(length(q) - 1, 1)), lambda i: substr(q, i, 3)) || list_transform(range(1, greatest(length(q), 1)), lambda i: substr(q, i, 2))) AS g FROM qd) GROUP BY ALL),
    cg AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, greatest(length(dense) - 2, 1)), lambda i: substr(dense, i, 4)) || list_transform(range(1, greatest(length(dense) - 1, 1)), lambda i: substr(dense, i, 3)) || list_transform(range(1, greatest(length(dense), 1)), lambda i: substr(dense, i, 2))) AS g FROM kc),
    gs AS (SELECT query_id, chunk_id, sum(points) AS s FROM qg JOIN cg USING (g) GROUP BY ALL),
    qw AS (SELECT query_id, w, count(*) AS times FROM (SELECT query_id, unnest(words) AS w FROM qd) GROUP BY ALL),
    ws AS (SELECT query_id, chunk_id, sum(times * CASE WHEN list_contains(own, w) THEN 3 WHEN contains(dense, w) THEN 1 ELSE 0 END) AS s FROM qw CROSS JOIN kc GROUP BY ALL),
    ks AS (SELECT query_id, chunk_id, CAST(coalesce(gs.s, 0) + coalesce(ws.s, 0) AS DOUBLE) AS score FROM gs FULL OUTER JOIN ws USING (query_id, chunk_id)),
    kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ks WHERE score > 0) WHERE rank <= 10)"""


@query("keyword_search", f"WITH {KEYWORD_SQL} SELECT query_id, chunk_id, rank, score FROM kr")
def keyword_search(spark, sf_dir):
    """Token and n-gram scorer over the 600-character chunks of all documents."""
    hits = keyword.keyword_search(questions(spark, sf_dir), pieces(spark, sf_dir), 10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


@query("keyword_hybrid_search")
def keyword_hybrid_search(spark, sf_dir):
    """Keyword and dense lists over whole documents with title points and anchor keeping."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("title"))
    asked = questions(spark, sf_dir)
    words = keyword.keyword_search(asked, docs, 30)
    near = dense_hits(spark, sf_dir, 30)
    pairs = words.select("query_id", "chunk_id").unionByName(near.select("query_id", "chunk_id")).distinct()
    points = pairs.join(docs.select("chunk_id", "title"), "chunk_id").join(asked, "query_id").select(
        "query_id", "chunk_id", keyword.metadata_points(F.col("text"), F.col("title")).alias("points")
    )
    return keyword.hybrid_search(words, near, points, 5).select("query_id", "chunk_id", "position", F.round("score", 6).alias("score"))


def corpus(spark, sf_dir):
    """Parents, and children with embeddings, written once per state of the table.

    A batch of questions reads the children once and keeps the words it asks for,
    so no index of all words lies beside them.
    """
    name = files_digest(read_table(spark, sf_dir, "documents"))
    order = F.col("source_id").cast("long") * 100_000_000 + F.col("parent_index") * 10_000 + F.col("child_index")
    with wide_rows(spark, WIDE_READ_ROWS):
        parents = kept(lambda: chunking.parents_of(units(spark, sf_dir), 256), spark, folder(spark, "parents", name))
        made = lambda: retrieve.build_corpus(chunking.children_of(parents, 64).withColumn("chunk_id", order), parents).chunks
        chunks = kept(made, spark, folder(spark, "chunks", name))
    return retrieve.Corpus(chunks, parents, retrieve.build_index(chunks))


@query("hybrid_retrieve")
def hybrid_retrieve(spark, sf_dir):
    """Full route: lexical and dense children, fusion, routing, second stage, parents."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    out = retrieve.retrieve(asked, corpus(spark, sf_dir))
    return out.select("query_id", "rank", "id", "child_chunk_id", "branch", "score", "bm25_score", "embedding_score", "rrf_score")


@query("retrieve_recall")
def retrieve_recall(spark, sf_dir):
    """Document recall of the full route on planted passages."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    contexts = retrieve.retrieve(asked, corpus(spark, sf_dir)).select("query_id", F.col("source").cast("long").alias("chunk_id"))
    cases = metrics.document_recall(contexts, gold_pairs(spark, sf_dir), asked)
    return cases.agg(
        F.count("*").alias("n_queries"), F.sum((F.col("gold_count") > 0).cast("long")).alias("n_with_gold"), F.round(F.avg("recall"), 6).alias("mean_recall")
    )


@query("answer_batch")
def answer_batch(spark, sf_dir):
    """Every item asked as a question without a generator: gate, thresholds and refusals."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    out = ask.answer(asked, corpus(spark, sf_dir))
    return out.select("query_id", "route", "status", "answer")
