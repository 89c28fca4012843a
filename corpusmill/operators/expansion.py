"""From retrieved chunks to evidence contexts: parents, neighbours, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import compact, text_of


def expand_parents(selected: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """Replace ranked children by their parents, first occurrence wins.

    A child without a parent row stays itself, so nothing is lost.
    """
    joined = selected.join(
        parents.select(
            "parent_id", F.col("content").alias("parent_content"), F.col("title").alias("parent_label"), F.col("page").alias("parent_page")
        ),
        "parent_id",
        "left",
    )
    found = F.col("parent_content").isNotNull()
    joined = joined.withColumn("context_id", F.when(found, F.col("parent_id")).otherwise(F.col("child_id"))).withColumn(
        "context_content", F.when(found, F.col("parent_content")).otherwise(text_of("content"))
    ).withColumn("context_title", F.when(found, F.col("parent_label")).otherwise(F.col("title")))
    first = W.partitionBy("query_id", "context_id").orderBy("rank")
    kept = joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    order = W.partitionBy("query_id").orderBy("rank")
    ranked = kept.withColumn("context_rank", F.row_number().over(order))
    return ranked.filter(F.col("context_rank") <= max(1, int(limit))) if limit is not None else ranked


def base_title(title: Column) -> Column:
    """Title without its ``/ part n`` suffix."""
    return F.regexp_replace(text_of(title), r"(?U)\s*/\s*part\s+\d+$", "")


def neighbor_expand(ranked: DataFrame, chunks: DataFrame, window: int = 1, max_contexts: int = 8) -> DataFrame:
    """Siblings within ``window`` positions of every hit, nearest first, distinct.

    The band join becomes an equi-join: each hit lists the few positions it wants.
    """
    wanted = ranked.select(
        "query_id",
        "rank",
        "section_id",
        F.col("chunk_index").alias("hit_index"),
        F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"),
    )
    found = wanted.join(chunks, ["section_id", "chunk_index"]).withColumn(
        "distance", F.abs(F.col("chunk_index") - F.col("hit_index"))
    )
    first = W.partitionBy("query_id", "chunk_id").orderBy("rank", "distance", "chunk_index")
    order = W.partitionBy("query_id").orderBy("rank", "distance", "chunk_index")
    kept = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_contexts)


def sentence_pairs(units: DataFrame, keys: tuple[str, ...], order: str, content: str, max_chars: int = 480, min_chars: int = 8) -> DataFrame:
    """Units plus windows of two adjacent units that still fit ``max_chars``."""
    following = F.lead(content).over(W.partitionBy(*keys).orderBy(order))
    paired = units.withColumn("_pair", F.trim(F.concat_ws(" ", F.col(content), following))).withColumn("_has", following.isNotNull())
    singles = units.select(*keys, order, F.lit(False).alias("is_pair"), F.col(content).alias("content"))
    pairs = paired.filter(F.col("_has") & (F.length("_pair") <= max_chars)).select(
        *keys, order, F.lit(True).alias("is_pair"), F.col("_pair").alias("content")
    )
    return singles.unionByName(pairs).filter(F.length("content") >= min_chars)


def normalize_contexts(contexts: DataFrame, max_contexts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Contexts without blanks, renumbered; cut to a prompt's size only when asked."""
    kept = contexts.filter(F.trim(text_of("content")) != "")
    if max_chars is not None:
        kept = kept.withColumn("content", F.substring("content", 1, max_chars))
    order = W.partitionBy("query_id").orderBy("rank")
    kept = kept.withColumn("rank", F.row_number().over(order))
    return kept if max_contexts is None else kept.filter(F.col("rank") <= max_contexts)


def preserve_anchors(ranked: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """The best ``k`` by keyword score among the fused top ``k`` and strong keyword hits.

    ``ranked(query_id, chunk_id, score, rank)``, ``keyword(query_id, chunk_id,
    keyword_score, keyword_rank)``. A hit is strong among the first max(k, 8)
    keyword rows when it has 12 points and 55 % of the best. The result is
    ordered by fused score.
    """
    query = W.partitionBy("query_id")
    pool = ranked.join(keyword, ["query_id", "chunk_id"], "left").withColumn("most", F.max("keyword_score").over(query))
    strong = (F.col("keyword_rank") <= max(k, 8)) & (F.col("keyword_score") >= F.greatest(F.lit(12.0), 0.55 * F.col("most")))
    by_words = query.orderBy(F.coalesce("keyword_score", F.lit(0.0)).desc(), F.desc("score"), "rank")
    kept = pool.filter((F.col("rank") <= k) | strong).withColumn("_n", F.row_number().over(by_words)).filter(F.col("_n") <= k)
    return kept.select("query_id", "chunk_id", "score", F.row_number().over(query.orderBy(F.desc("score"), "rank")).alias("position"))


def without_near_copies(units: Column, limit: int, ratio: float) -> Column:
    """The first ``limit`` of ordered units that are no near copies of earlier kept ones.

    Elements carry ``dense``, their text without blanks. A unit is a near copy
    when a kept one contains it, or when it contains a kept one that makes up
    ``ratio`` of it.
    """

    def near(new: Column, old: Column) -> Column:
        inside = F.contains(new["dense"], old["dense"]) & (old["dense"] != "")
        return F.contains(old["dense"], new["dense"]) | (inside & (F.length(old["dense"]) >= ratio * F.length(new["dense"])))

    def add(kept: Column, new: Column) -> Column:
        refuse = (F.size(kept) >= max(1, limit)) | F.exists(kept, lambda old: near(new, old))
        return F.when(refuse, kept).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(units, F.filter(units, lambda _: F.lit(False)), add)


def drop_near_copies(ranked: DataFrame, limit: int, ratio: float = 0.8) -> DataFrame:
    """Best units per query without near copies; ``ranked(query_id, unit_index, score, content)``."""
    unit = F.struct((-F.col("score")).alias("order"), "unit_index", "score", "content", compact(F.col("content")).alias("dense"))
    grouped = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    rows = grouped.select("query_id", F.posexplode(without_near_copies(F.col("units"), limit, ratio)).alias("at", "u"))
    return rows.select("query_id", "u.unit_index", "u.score", "u.content", (F.col("at") + 1).alias("position"))
