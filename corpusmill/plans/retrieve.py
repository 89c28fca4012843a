"""Retrieval from questions to gated evidence contexts, for a whole batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.functions.text import embedding_text, indexed_text, text_of
from corpusmill.operators import dense, evidence, expansion, fusion, planning, rerank, sparse
from corpusmill.operators.embed import Embedder, PairScorer, embed, hashing_embedder, overlap_scorer
from corpusmill.operators.postings import PostingStore
from corpusmill.session import broadcast_bounded, broadcast_checked, stage_few


@dataclass(frozen=True)
class Corpus:
    """Search units, their parents, and the index built over the units.

    ``chunks(chunk_id long, child_id, parent_id, source_id, parent_title, title,
    page, content, embedding)``; ``parents(parent_id, title, page, content)``.
    """

    chunks: DataFrame
    parents: DataFrame
    index: sparse.SparseIndex | PostingStore


def build_index(chunks: DataFrame) -> sparse.SparseIndex:
    """Index over titles, source and text."""
    text = indexed_text(F.col("parent_title"), F.col("title"), F.col("source_id"), F.col("page"), F.col("content"))
    return sparse.build_index(chunks.withColumn("_text", text), "_text", source_id="source_id")


def build_corpus(children: DataFrame, parents: DataFrame, factory: Callable[[], Embedder] = hashing_embedder) -> Corpus:
    """Number the children by their place and index titles, source and text."""
    chunks = children.withColumn("page", text_of("page")).withColumn(
        "embedding", embed(embedding_text(F.col("parent_title"), F.col("title"), F.col("content")), factory)
    )
    return Corpus(chunks, parents, build_index(children))


def _clamp_k(settings: Settings, top_k: int | None, candidate_k: int | None) -> tuple[int, int]:
    """The caller's values as they are; only values of the settings obey the settings' bounds."""
    k = int(top_k) if top_k else min(settings.hybrid_top_k, settings.hybrid_max_top_k)
    pool = int(candidate_k) if candidate_k else min(settings.hybrid_candidate_k, settings.hybrid_max_candidate_k)
    if k < 1 or pool < 1:
        raise ValueError("top_k and candidate_k must be positive")
    return k, max(k, pool)


def retrieve(
    questions: DataFrame,
    corpus: Corpus,
    settings: Settings | None = None,
    top_k: int | None = None,
    candidate_k: int | None = None,
    allowed: DataFrame | None = None,
    aliases: DataFrame | None = None,
    embedder: Callable[[], Embedder] = hashing_embedder,
    scorer: Callable[[], PairScorer] = overlap_scorer,
) -> DataFrame:
    """Ranked contexts per question.

    ``questions(query_id long, question[, retrieval_query, variants])``;
    ``allowed(source_id)`` limits the candidates, never the statistics.
    """
    settings = (settings or Settings()).normalized()
    k, pool = _clamp_k(settings, top_k, candidate_k)
    asked = questions
    if "retrieval_query" not in asked.columns:
        asked = asked.withColumn("retrieval_query", F.lit(""))
    if "variants" not in asked.columns:
        asked = asked.withColumn("variants", F.array().cast("array<string>"))
    if aliases is not None:
        asked = planning.expand_with_aliases(asked, aliases).withColumn("retrieval_query", F.concat_ws(" ", "retrieval_query", F.array_join("added_terms", " ")))
    limit = settings.multi_query_max_variants if settings.multi_query_enabled else 1
    planned = planning.planned_queries(asked, limit)

    keys = ("query_id", "variant")
    lexical = sparse.bm25_search(
        planned, corpus.index, pool, keys=keys, k1=settings.hybrid_bm25_k1, b=settings.hybrid_bm25_b, allowed=allowed, with_terms=True
    )
    # Dense search takes one id per planned query: both parts as text, whatever their size.
    pair = F.concat_ws(":", F.col("variant"), F.col("query_id"))
    numbered = planned.select(pair.alias("query_id"), embed(F.col("text"), embedder).alias("embedding"))
    near = dense.dense_search(numbered, corpus.chunks.select("chunk_id", "source_id", "embedding"), pool, allowed=allowed)
    near = near.withColumn("variant", F.substring_index("query_id", ":", 1).cast("int")).withColumn(
        "query_id", F.expr("substring(query_id, instr(query_id, ':') + 1)").cast(planned.schema["query_id"].dataType)
    )
    lists = fusion.as_list(lexical, F.col("variant"), "bm25").unionByName(fusion.as_list(near, F.col("variant") + limit, "embedding"))
    fused = fusion.weighted_rrf(
        lists, settings.hybrid_rrf_k, settings.keyword_weight, settings.embedding_weight, limit=max(k, pool)
    )
    if settings.hybrid_fusion_method == "lambdamart":
        fused = fusion.rank_map_fusion(fused, settings.keyword_weight, settings.embedding_weight)

    variants = F.size("variants")
    shape = planning.complexity(F.col("question"), n_variants=variants, threshold=settings.query_complexity_threshold)
    answer_text = planned.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "text"))), lambda s: s["text"]), " ").alias("query_text")
    )
    routed = asked.select("query_id", (shape["is_complex"] if settings.complexity_routing_enabled else F.lit(True)).alias("is_complex"))
    texts = corpus.chunks.select(
        "chunk_id", "child_id", "parent_id", "title", "page", "source_id", "content",
        indexed_text(F.col("parent_title"), F.col("title"), F.col("source_id"), F.col("page"), F.col("content")).alias("full_text"),
    )
    # A pool of candidates per question goes to the texts; the corpus is not shuffled.
    # Both routes read the pool, which is searched once.
    few = stage_few(fused.join(answer_text, "query_id").join(routed, "query_id"), "pool")
    few = broadcast_bounded(few, questions.count() * max(k, pool), 2000)
    candidates = texts.join(few, "chunk_id")

    def second_stage(part: DataFrame) -> DataFrame:
        if settings.hybrid_fusion_method == "rrf":
            return rerank.cross_encoder_rerank(part, k, scorer, chunk_text="content")
        weights = {
            "fusion": settings.rerank_fusion_weight, "bm25": settings.rerank_bm25_weight, "embedding": settings.rerank_embedding_weight,
            "coverage": settings.rerank_coverage_weight, "phrase": settings.rerank_phrase_weight,
        }
        return rerank.feature_rerank(part, k, chunk_text="full_text", weights=weights)

    chosen = rerank.routed_rerank(candidates, k, second_stage, settings.simple_query_top_k)
    chosen = chosen.withColumn("fused_rank", F.col("rank")).withColumn("rank", F.col("rerank_rank"))
    # At most k rows per question go to the parents; the parents are not shuffled.
    chosen = stage_few(chosen.drop("full_text", "query_text"), "chosen")
    parents = corpus.parents.join(broadcast_checked(chosen.select("parent_id").distinct()), "parent_id", "left_semi")
    contexts = expansion.expand_parents(chosen, parents, limit=k)
    r6 = lambda c: F.round(F.col(c), 6)
    return contexts.select(
        "query_id",
        F.col("context_rank").alias("rank"),
        F.col("context_id").alias("id"),
        F.col("child_id").alias("child_chunk_id"),
        F.col("parent_id").alias("parent_chunk_id"),
        F.col("context_title").alias("title"),
        F.col("source_id").alias("source"),
        F.coalesce("parent_page", "page").alias("page"),
        F.col("context_content").alias("content"),
        F.when(F.col("rerank_applied"), "fusion + reranker").otherwise("fusion (direct top-k)").alias("branch"),
        r6("rerank_score").alias("score"),
        r6("bm25_score").alias("bm25_score"),
        r6("embedding_score").alias("embedding_score"),
        r6("rrf_score").alias("rrf_score"),
        r6("rerank_score").alias("rerank_score"),
        "matched_terms",
    )


def gated(questions: DataFrame, contexts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Gate decision per question, including questions that found nothing."""
    settings = (settings or Settings()).normalized()
    return evidence.evidence_gate(
        contexts,
        questions,
        settings.evidence_gate_mode,
        settings.hybrid_min_bm25_score,
        settings.hybrid_min_embedding_score,
        settings.hybrid_high_embedding_score,
    )
