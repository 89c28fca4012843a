"""Second-stage ranking of fused candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import bm25_tokens, compact, find_all, let, multi_ngrams, phrase_bonus
from corpusmill.operators.embed import PairScorer, overlap_scorer, pair_score
from corpusmill.operators.sparse import RANK_DIGITS

# Default weights of the feature reranker.
FEATURE_WEIGHTS = {"fusion": 0.30, "bm25": 0.32, "embedding": 0.26, "coverage": 0.10, "phrase": 0.02}

# Question words that carry no ranking information.
RERANK_STOP_TERMS = (
    "什麼", "為什麼", "如何", "哪裡", "哪種", "問題", "核心", "主要", "代表", "得到", "提到", "造成", "認為", "需要", "希望",
)
PHRASE_STOP_FRAGMENTS = ("的是", "什麼", "哪一", "哪個", "哪本", "一本", "問題", "主要", "開始", "後來", "要求")


def coverage(query_terms: Column, text_terms: Column) -> Column:
    """Share of the distinct query terms that occur in the text."""
    return F.size(F.array_intersect(query_terms, text_terms)) / F.greatest(F.size(query_terms), F.lit(1))


def feature_rerank(
    candidates: DataFrame,
    k: int,
    query_text: str = "query_text",
    chunk_text: str = "chunk_text",
    weights: dict[str, float] | None = None,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Weighted sum of normalized fusion, bm25, dense, coverage and phrase features.

    ``candidates`` carries ``fusion_score, bm25_score, embedding_score`` and both
    texts; it is a candidate pool (at most 100 rows per query).
    """
    w = dict(FEATURE_WEIGHTS, **(weights or {}))
    total = sum(max(0.0, v) for v in w.values()) or 1.0
    w = {name: max(0.0, v) / total for name, v in w.items()}
    fusion = F.col("lambda_mart_fusion_score") if "lambda_mart_fusion_score" in candidates.columns else F.col("fusion_score")
    group = W.partitionBy(*keys)
    low, high = F.min("embedding_score").over(group), F.max("embedding_score").over(group)
    top_bm25, top_fusion = F.max("bm25_score").over(group), F.max(fusion).over(group)
    # The pool is small in bytes but costly per row: use all reducers for it.
    partitions = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = (
        candidates.repartition(partitions, *keys, "chunk_id")
        .withColumn("_q", F.array_distinct(bm25_tokens(query_text)))
        .withColumn("_c", F.array_distinct(bm25_tokens(chunk_text)))
        .withColumn("coverage", coverage(F.col("_q"), F.col("_c")))
        .withColumn("_covered", F.array_intersect("_q", "_c"))
        .withColumn("phrase", phrase_bonus(F.col(query_text), F.col(chunk_text)))
        .withColumn("_nf", F.when(top_fusion != 0, fusion / top_fusion).otherwise(F.lit(0.0)))
        .withColumn("_nb", F.when(top_bm25 != 0, F.col("bm25_score") / top_bm25).otherwise(F.lit(0.0)))
        .withColumn("_ne", (F.col("embedding_score") - low) / F.greatest(high - low, F.lit(1e-9)))
    )
    scored = scored.withColumn(
        "rerank_score",
        w["fusion"] * F.col("_nf")
        + w["bm25"] * F.col("_nb")
        + w["embedding"] * F.col("_ne")
        + w["coverage"] * F.col("coverage")
        + w["phrase"] * F.col("phrase"),
    )
    if "matched_terms" in candidates.columns:
        scored = scored.withColumn(
            "matched_terms", F.array_distinct(F.concat("matched_terms", "_covered"))
        )
    previous = F.col("rank") if "rank" in candidates.columns else F.lit(0)
    window = W.partitionBy(*keys).orderBy(F.round("rerank_score", RANK_DIGITS).desc(), previous.asc(), F.asc("chunk_id"))
    return (
        scored.withColumn("rerank_rank", F.row_number().over(window))
        .filter(F.col("rerank_rank") <= k)
        .drop("_q", "_c", "_covered", "_nf", "_nb", "_ne")
    )


def cross_encoder_rerank(
    candidates: DataFrame,
    k: int,
    factory: Callable[[], PairScorer] = overlap_scorer,
    query_text: str = "query_text",
    chunk_text: str = "chunk_text",
    keys: tuple[str, ...] = ("query_id",),
    pool: int = 100,
) -> DataFrame:
    """Pair scores for the best ``pool`` candidates, ties by RRF score then order.

    The pool is cut before the model runs, so its cost is bounded per query.
    """
    bounded = candidates.filter(F.col("rank") <= pool)
    scored = bounded.withColumn("rerank_score", pair_score(F.col(query_text), F.col(chunk_text), factory))
    window = W.partitionBy(*keys).orderBy(
        F.round("rerank_score", RANK_DIGITS).desc(), F.round("rrf_score", 12).desc(), F.asc("rank")
    )
    return scored.withColumn("rerank_rank", F.row_number().over(window)).filter(F.col("rerank_rank") <= k)


def routed_rerank(candidates: DataFrame, k: int, reranked: Callable[[DataFrame], DataFrame], simple_k: int = 5) -> DataFrame:
    """Complex questions are reranked, simple ones keep their fused order.

    ``candidates`` carries ``is_complex``; splitting the frame keeps the model
    away from simple questions altogether.
    """
    complex_part = reranked(candidates.filter(F.col("is_complex"))).withColumn("rerank_applied", F.lit(True))
    simple_part = (
        candidates.filter(~F.col("is_complex") & (F.col("rank") <= min(k, simple_k)))
        .withColumn("rerank_score", F.col("rrf_score"))
        .withColumn("rerank_rank", F.col("rank"))
        .withColumn("rerank_applied", F.lit(False))
    )
    return complex_part.unionByName(simple_part, allowMissingColumns=True)


def rerank_terms(text: Column) -> Column:
    """Distinct terms of a question worth matching."""
    words = F.transform(find_all(text, r"[A-Za-z0-9_.-]+|[\x{4e00}-\x{9fff}]{2,}"), F.lower)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*RERANK_STOP_TERMS)))


def phrase_terms(text: Column) -> Column:
    """4- and 3-character windows of the question without stop fragments."""
    dense = F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", "")

    def clean(term: Column) -> Column:
        bad = F.lit(False)
        for fragment in PHRASE_STOP_FRAGMENTS:
            bad = bad | F.contains(term, F.lit(fragment))
        return ~bad

    return F.filter(multi_ngrams(dense, (4, 3)), clean)


def covered_count(terms: Column, compact_text: Column) -> Column:
    return let(compact_text, lambda body: F.size(F.filter(terms, lambda t: F.contains(body, compact(t)))))


def coverage_boost(
    candidates: DataFrame, weight: float = 0.20, question: str = "query_text", rewritten: str | None = None, chunk_text: str = "chunk_text"
) -> DataFrame:
    """Add ``weight * covered / terms`` over the question's terms."""
    both = F.concat_ws(" ", F.col(question), F.col(rewritten)) if rewritten else F.col(question)
    terms = F.array_distinct(F.concat(rerank_terms(both), phrase_terms(F.col(question))))
    boosted = candidates.withColumn("_t", terms)
    share = F.when(
        F.size("_t") > 0, covered_count(F.col("_t"), compact(F.col(chunk_text))) / F.size("_t")
    ).otherwise(F.lit(0.0))
    return boosted.withColumn("coverage", share).withColumn("score", F.col("score") + weight * F.col("coverage")).drop("_t")


def choice_boost(text: Column, anchor: Column, choices: Column) -> Column:
    """Bonus for A-or-B questions when the subject and a choice both occur."""
    body = compact(text)
    hits = covered_count(choices, body)
    return F.when(
        (anchor != "") & F.contains(body, compact(anchor)) & (hits > 0), F.lit(2.2) + 0.18 * F.least(hits, F.lit(2))
    ).otherwise(F.lit(0.0))


def definition_rank_boost(rank: Column) -> Column:
    """Bonus by the position in the definition search."""
    return (
        F.when(rank <= 3, F.lit(0.35) - 0.05 * (rank - 1)).when(rank <= 8, F.lit(0.10)).otherwise(F.lit(0.0))
    )


def attention_order(rank: Column) -> Column:
    """Sort key putting ranks 1, 3, 5 first and 6, 4, 2 last."""
    return F.when(rank % 2 == 1, rank).otherwise(F.lit(1_000_000) - rank)
