"""Retrieval inside tenants, knowledge bases and immutable index versions.

Term vectors and embeddings of all scopes lie in one table, in folders of tenant,
base and version. A batch of questions names its scopes; joined as the small side,
they prune the folders while the job runs. Statistics are those of a scope alone.
A question without tenant, base or version finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import text_of
from corpusmill.operators import dense, fusion, sparse
from corpusmill.operators.embed import Embedder, embed, hashing_embedder
from corpusmill.session import broadcast_checked, fits_broadcast, salted_join, stage

SCOPE = ("tenant_id", "kb_id", "index_version_id")
GIVEN = " AND ".join(f"coalesce(trim({c}), '') <> ''" for c in SCOPE)


def write_corpus(chunks: DataFrame, path: str, text: str = "content") -> None:
    """Append ``SCOPE, chunk_id, source_id, text, embedding`` as an index laid out by scope.

    A version is written once; rows without a whole scope are an error.
    """
    if not chunks.where(f"NOT ({GIVEN})").isEmpty():
        raise ValueError("reads and writes need tenant, knowledge base and index version")
    carried = chunks.select("chunk_id", F.struct(*SCOPE, "embedding").alias("carried"))
    vectors = sparse.build_index(chunks, text, source_id="source_id").vectors.join(carried, "chunk_id")
    placed = vectors.select("chunk_id", "source_id", "length", "terms", "carried.*").select("chunk_id", "source_id", "length", "terms", "embedding", *SCOPE)
    # Ordered by scope over all tasks: a folder gets few files, a large scope is spread.
    placed.repartitionByRange(*SCOPE, "chunk_id").write.mode("append").partitionBy(*SCOPE).parquet(path)


def combined_query(question, retrieval_query):
    """Question and search text, each once, without empty ones."""
    parts = F.transform(F.array(text_of(question), text_of(retrieval_query)), lambda t: F.trim(t))
    return F.array_join(F.array_distinct(F.filter(parts, lambda t: t != "")), " ")


def lexical_hits(asked: DataFrame, corpus: DataFrame, k: int, allowed: DataFrame | None = None, k1: float = 1.4, b: float = 0.72) -> DataFrame:
    """BM25 top ``k`` in each question's scope, with the statistics of the whole scope."""
    terms = stage(sparse.query_terms(asked, "text", ("query_id", *SCOPE)), "terms")
    small = fits_broadcast(terms)
    asked_scopes = terms.select(*SCOPE).distinct()
    here = corpus.join(F.broadcast(asked_scopes) if small else asked_scopes, list(SCOPE), "left_semi")
    sizes = here.groupBy(*SCOPE).agg(F.count("*").alias("n_chunks"), F.avg("length").alias("mean"))
    postings = here.select(*SCOPE, "chunk_id", "source_id", "length", F.explode("terms").alias("t")).select(*SCOPE, "chunk_id", "source_id", "length", "t.term", "t.tf")
    wanted = terms.select(*SCOPE, "term").distinct()
    kept = stage(postings.join(F.broadcast(wanted) if small else wanted, [*SCOPE, "term"], "left_semi"), "postings")
    frequencies = kept.groupBy(*SCOPE, "term").agg(F.count("*").alias("df"))
    weights = terms.join(frequencies, [*SCOPE, "term"]).join(sizes, list(SCOPE))
    weights = weights.select("query_id", *SCOPE, "term", "mean", (sparse.idf(F.col("n_chunks"), F.col("df")) * (1 + F.log("qf"))).alias("weight"))
    weights = stage(weights, "weights")
    if allowed is not None:
        kept = kept.join(broadcast_checked(allowed.select("source_id").distinct()), "source_id", "left_semi")
    if small:
        matched = kept.join(F.broadcast(weights), [*SCOPE, "term"])
    else:
        key = F.struct(*SCOPE, "term")
        matched = salted_join(kept.withColumn("_key", key), weights.withColumn("_key", key).drop(*SCOPE, "term"), "_key", "chunk_id")
    part = sparse.term_score(F.col("weight"), F.col("tf"), F.col("length"), F.col("mean"), k1, b)
    scored = matched.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")
    return sparse.top_k(scored, ("query_id",), k, "score", "chunk_id")


def scoped_retrieve(
    questions: DataFrame, spark: SparkSession, path: str, k: int = 5, candidate_k: int = 30, allowed: DataFrame | None = None,
    bm25_weight: float = 0.6, embedding_weight: float = 0.4, rrf_k: int = 60, embedder: Callable[[], Embedder] = hashing_embedder,
) -> DataFrame:
    """``query_id, rank, chunk_id, source_id, fusion_score, bm25_score, embedding_score``.

    ``questions(query_id, question, retrieval_query, SCOPE)``; ``allowed(source_id)``
    limits the candidates, not the statistics.
    """
    if k < 1 or candidate_k < 1:
        raise ValueError("k and candidate_k must be positive")
    pool = max(k, candidate_k)
    asked = questions.where(GIVEN).select("query_id", *SCOPE, combined_query("question", "retrieval_query").alias("text"))
    corpus = spark.read.parquet(path)
    corpus = corpus.select(*[F.col(c).cast("string").alias(c) if c in SCOPE else F.col(c) for c in corpus.columns])
    words = lexical_hits(asked, corpus, pool, allowed)
    open_to = corpus if allowed is None else corpus.join(broadcast_checked(allowed.select("source_id").distinct()), "source_id", "left_semi")
    near = dense.scoped_dense_search(asked.withColumn("embedding", embed(F.col("text"), embedder)), open_to, pool, SCOPE)
    lists = fusion.as_list(words, 0, "bm25").unionByName(fusion.as_list(near, 1, "embedding"))
    fused = fusion.weighted_rrf(lists, rrf_k, bm25_weight, embedding_weight, limit=k)
    sources = corpus.select(*SCOPE, "chunk_id", "source_id")
    found = fused.join(asked.select("query_id", *SCOPE), "query_id")
    out = sources.join(broadcast_checked(found), [*SCOPE, "chunk_id"])
    return out.select("query_id", "rank", "chunk_id", "source_id", "fusion_score", "bm25_score", "embedding_score")
