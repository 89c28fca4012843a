"""Rank and score fusion of candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.vectors import finite
from corpusmill.operators.sparse import RANK_DIGITS

MISSING_RANK = 1_000_000_000


def normalize_weights(bm25_weight: float, embedding_weight: float) -> tuple[float, float]:
    bm25, embedding = max(0.0, float(bm25_weight)), max(0.0, float(embedding_weight))
    total = bm25 + embedding
    return (0.5, 0.5) if total <= 0 else (bm25 / total, embedding / total)


def as_list(hits: DataFrame, list_no: int | Column, branch: str, keys=("query_id",)) -> DataFrame:
    """Tag ranked hits as one input list of a fusion."""
    terms = F.col("matched_terms") if "matched_terms" in hits.columns else F.array().cast("array<string>")
    return hits.select(
        *keys,
        (list_no if isinstance(list_no, Column) else F.lit(list_no)).cast("int").alias("list_no"),
        F.lit(branch).alias("branch"),
        "chunk_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("score").cast("double").alias("score"),
        terms.alias("matched_terms"),
    )


def weighted_rrf(
    lists: DataFrame,
    rrf_k: int = 60,
    bm25_weight: float = 0.6,
    embedding_weight: float = 0.4,
    keys: tuple[str, ...] = ("query_id",),
    limit: int | None = 100,
) -> DataFrame:
    """Weighted reciprocal rank fusion over any number of lists.

    Ties keep insertion order, i.e. the first list and rank a chunk appears in;
    lexical lists carry lower list numbers than dense ones.
    """
    w_bm25, w_dense = normalize_weights(bm25_weight, embedding_weight)
    is_bm25 = F.col("branch") == "bm25"
    part = F.when(is_bm25, F.lit(w_bm25)).otherwise(F.lit(w_dense)) / (max(1, int(rrf_k)) + F.col("rank"))
    fused = lists.groupBy(*keys, "chunk_id").agg(
        F.sum(part).alias("fusion_score"),
        F.coalesce(F.max(F.when(is_bm25, F.col("score"))), F.lit(0.0)).alias("bm25_raw"),
        F.coalesce(F.max(F.when(~is_bm25, F.col("score"))), F.lit(0.0)).alias("dense_raw"),
        F.min(F.struct("list_no", "rank")).alias("first_seen"),
        # At most one row per input list and chunk, so this array is bounded.
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("list_no", "matched_terms"))), lambda s: s["matched_terms"]
                )
            )
        ).alias("matched_terms"),
    )
    fused = fused.select(
        *keys,
        "chunk_id",
        "fusion_score",
        F.greatest(F.lit(0.0), F.col("bm25_raw")).alias("bm25_score"),
        F.greatest(F.lit(0.0), F.col("dense_raw")).alias("embedding_score"),
        F.col("fusion_score").alias("rrf_score"),
        "matched_terms",
        "first_seen",
    )
    window = W.partitionBy(*keys).orderBy(
        F.round("fusion_score", 12).desc(), F.col("first_seen").asc(), F.col("chunk_id").asc()
    )
    ranked = fused.withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def rank_tie_rrf(
    sparse: DataFrame, dense: DataFrame, k: int, rrf_k: int = 60, bm25_weight: float = 0.6, embedding_weight: float = 0.4
) -> DataFrame:
    """Two-list RRF whose ties go to bm25 rank, then dense rank, then chunk id."""
    w_bm25, w_dense = normalize_weights(bm25_weight, embedding_weight)
    left = sparse.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    right = dense.select(
        "query_id", "chunk_id", F.col("rank").alias("embedding_rank"), F.col("score").alias("embedding_score")
    )
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(F.lit(w_bm25) / (rrf_k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(
        F.lit(w_dense) / (rrf_k + F.col("embedding_rank")), F.lit(0.0)
    )
    joined = joined.withColumn("rrf_score", score)
    window = W.partitionBy("query_id").orderBy(
        F.round("rrf_score", 12).desc(),
        F.coalesce("bm25_rank", F.lit(MISSING_RANK)),
        F.coalesce("embedding_rank", F.lit(MISSING_RANK)),
        F.col("chunk_id"),
    )
    return joined.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def named_list_rrf(
    lists: DataFrame, k: int, rrf_k: int = 60, keyword_weight: float = 0.6, embedding_weight: float = 0.4
) -> DataFrame:
    """RRF where the list name picks the weight (lexical, dense, anything else 1)."""
    name = F.lower(F.col("list_name"))
    weight = (
        F.when(name.rlike("bm25|sparse"), F.lit(float(keyword_weight)))
        .when(name.rlike("dense|embedding"), F.lit(float(embedding_weight)))
        .otherwise(F.lit(1.0))
    )
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(weight / (rrf_k + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("first_seen")
    )
    window = W.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "first_seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("first_seen")


def raw_fusion(sparse: DataFrame, dense: DataFrame, keyword_weight: float = 0.5, embedding_weight: float = 0.5) -> DataFrame:
    """Weighted sum of raw scores; a branch miss counts as 0."""
    left = sparse.select("query_id", "chunk_id", F.col("score").alias("bm25_score"))
    right = dense.select("query_id", "chunk_id", F.col("score").alias("embedding_score"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer").select(
        "query_id",
        "chunk_id",
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.coalesce("embedding_score", F.lit(0.0)).alias("embedding_score"),
    )
    return joined.withColumn(
        "fusion_score", keyword_weight * F.col("bm25_score") + embedding_weight * F.col("embedding_score")
    )


def rank_map(value: Column, *keys: str) -> Column:
    """Average rank over ties mapped to [0, 1]; non-positive scores map to 0."""
    group = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(group)
    position = F.rank().over(group.orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    mapped = (position + (ties - 1) / F.lit(2.0) - F.lit(1.0)) / F.nullif(n - F.lit(1.0), F.lit(0.0))
    return (
        F.when(value <= 0, F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise(mapped)
    )


def min_max(value: Column, *keys: str) -> Column:
    """Min-max scaling inside ``keys``; a flat group maps to 1 (positive) or 0."""
    group = W.partitionBy(*keys)
    value = finite(value)
    low, high = F.min(value).over(group), F.max(value).over(group)
    span = high - low
    return F.when(
        span <= 1e-12, F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span)))


def rank_map_fusion(
    candidates: DataFrame, keyword_weight: float = 0.5, embedding_weight: float = 0.5, keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Map both branches to [0, 1] by rank and add them; ties fall back to RRF."""
    w_kw, w_emb = normalize_weights(keyword_weight, embedding_weight)
    mapped = candidates.withColumn("_b", F.round(finite(F.col("bm25_score")), RANK_DIGITS)).withColumn(
        "_e", F.round(finite(F.col("embedding_score")), RANK_DIGITS)
    )
    mapped = mapped.withColumn("_mb", rank_map(F.col("_b"), *keys)).withColumn("_me", rank_map(F.col("_e"), *keys))
    mapped = (
        mapped.withColumn("mapped_bm25_score", F.round("_mb", 8))
        .withColumn("mapped_embedding_score", F.round("_me", 8))
        .withColumn("lambda_mart_fusion_score", F.round(w_kw * F.col("_mb") + w_emb * F.col("_me"), 8))
        .drop("_b", "_e", "_mb", "_me", "rank")
    )
    window = W.partitionBy(*keys).orderBy(
        F.desc("lambda_mart_fusion_score"), F.round("fusion_score", 12).desc(), F.asc("chunk_id")
    )
    return mapped.withColumn("rank", F.row_number().over(window))


def sum_of_methods(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add scores of two result lists and unite their method names."""
    both = left.unionByName(right)
    return both.groupBy("query_id", "chunk_id").agg(
        F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods")
    )


def reciprocal_scores(hits: DataFrame, method: str, weight: float = 1.0) -> DataFrame:
    return hits.select(
        "query_id", "chunk_id", (F.lit(float(weight)) / F.col("rank")).alias("score"), F.array(F.lit(method)).alias("methods")
    )


def ordered_union(first: DataFrame, second: DataFrame, key: str = "chunk_id", order: str = "rank") -> DataFrame:
    """UNION DISTINCT that keeps the order of ``first`` and then ``second``."""
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    window = W.partitionBy("query_id", key).orderBy("_part", order)
    kept = both.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    position = W.partitionBy("query_id").orderBy("_part", order)
    return kept.withColumn("position", F.row_number().over(position)).drop("_part")


def graph_vector_merge(graph: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Graph hits get ``3 - 0.05 * order`` on top; the better score survives."""
    left = graph.select("query_id", "chunk_id", F.col("rank").alias("graph_rank"))
    right = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer")
    bonus = F.lit(3.0) - 0.05 * (F.col("graph_rank") - 1)
    joined = joined.withColumn(
        "score", F.greatest(F.coalesce(bonus, F.lit(0.0)), F.coalesce("vector_score", F.lit(0.0)))
    ).withColumn(
        "method",
        F.when(F.col("graph_rank").isNotNull() & F.col("vector_rank").isNotNull(), "graph+vector")
        .when(F.col("graph_rank").isNotNull(), "graph")
        .otherwise("vector"),
    )
    window = W.partitionBy("query_id").orderBy(
        F.desc("score"), F.coalesce("graph_rank", F.lit(MISSING_RANK)), F.coalesce("vector_rank", F.lit(MISSING_RANK))
    )
    return joined.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
