"""Entities, relations and two-step graph retrieval as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import any_contains, compact
from corpusmill.operators.matching import contains_pairs
from corpusmill.operators.planning import classify

# Relation types and the question words that ask for them.
RELATION_TERMS = {
    "MEMBER_OF": ("屬於", "属于", "哪一派", "成員", "成员", "組織", "组织"),
    "LEADS": ("領導", "领导", "統帥", "统帅", "建立"),
    "PARTICIPATED_IN": ("參與", "参与", "涉及", "事件"),
    "LOCATED_IN": ("哪裡", "哪里", "地點", "地点", "基地"),
    "USES": ("使用", "用", "材料", "工具"),
    "HAS_GOAL": ("目的", "希望", "主張", "主张", "目標", "目标"),
}


def mentions(texts: DataFrame, entities: DataFrame, text_id: str, text: str) -> DataFrame:
    """``(text_id, entity_id)``: texts naming an entity by name or alias."""
    names = entities.select(
        "entity_id",
        F.explode(
            F.array_distinct(
                F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), compact)
            )
        ).alias("term"),
    ).filter("term <> ''")
    names = names.withColumn("term_no", F.xxhash64("entity_id", "term"))
    dense = texts.select(text_id, compact(F.col(text)).alias("_dense"))
    hits = contains_pairs(dense, names, text_id, "_dense", "term_no", "term")
    return hits.join(names.select("term_no", "entity_id"), "term_no").select(text_id, "entity_id").distinct()


def type_intent(relation_type: Column, question: Column) -> Column:
    dense = compact(question)
    out = F.lit(False)
    for name, terms in RELATION_TERMS.items():
        out = F.when(F.upper(relation_type) == name, any_contains(dense, terms)).otherwise(out)
    return out


def rank_relations(questions: DataFrame, relations: DataFrame, query_entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Relations touching a question's entities: 2 per endpoint, 1.5 for the asked type, half the confidence.

    ``query_entities(query_id, entity_id)``.
    """
    ends = relations.select("relation_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("entity_id"))
    overlap = query_entities.join(ends, "entity_id").groupBy("query_id", "relation_id").agg(F.count("*").alias("overlap"))
    typed = overlap.join(relations, "relation_id").join(questions.select("query_id", "question"), "query_id")
    score = (
        2.0 * F.col("overlap")
        + F.when(type_intent(F.col("type"), F.col("question")), 1.5).otherwise(0.0)
        + 0.5 * F.coalesce(F.col("confidence"), F.lit(0.0))
    )
    scored = typed.withColumn("score", score).filter("score > 0")
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "relation_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).drop("question")
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def relation_trace(ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """``A -TYPE-> B`` with names where known."""
    names = entities.select(F.col("entity_id"), "name")
    left = names.select(F.col("entity_id").alias("source"), F.col("name").alias("source_name"))
    right = names.select(F.col("entity_id").alias("target"), F.col("name").alias("target_name"))
    named = ranked.join(left, "source", "left").join(right, "target", "left")
    return named.withColumn(
        "trace",
        F.concat(
            F.coalesce("source_name", F.col("source").cast("string")), F.lit(" -"), F.col("type"), F.lit("-> "),
            F.coalesce("target_name", F.col("target").cast("string")),
        ),
    ).drop("source_name", "target_name")


def graph_context(
    questions: DataFrame, relations: DataFrame, query_entities: DataFrame, supports: DataFrame, limit: int = 8
) -> DataFrame:
    """Chunks behind the best relations of each non-content question.

    A chunk ranks by its best relation. Relations that touch no entity of the
    question still count by type and confidence; as that part of the score only
    depends on the relation's class, the best ``2 * limit`` chunks per class are
    enough, and questions meet them through an equi-join on the class.
    """
    asked = questions.filter(classify(F.col("question")) != "content").select("query_id", "question")
    ranked = rank_relations(asked, relations, query_entities)
    own = ranked.select("query_id", "relation_id", "score").join(supports, "relation_id").select(
        "query_id", "chunk_id", "score", "relation_id", "position"
    )
    known = F.upper("type").isin(*RELATION_TERMS)
    classed = relations.select(
        "relation_id", F.when(known, F.upper("type")).otherwise("OTHER").alias("class"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    ).join(supports, "relation_id")
    best = classed.groupBy("class", "chunk_id").agg(
        F.min_by(F.struct("confidence", "relation_id", "position"), F.struct(-F.col("confidence"), F.col("relation_id"), F.col("position"))).alias("b")
    )
    depth = W.partitionBy("class").orderBy(F.desc("b.confidence"), "b.relation_id", "b.position")
    best = best.withColumn("_n", F.row_number().over(depth)).filter(F.col("_n") <= 2 * limit)
    classes = asked.select("query_id", "question", F.explode(F.array(*[F.lit(c) for c in (*RELATION_TERMS, "OTHER")])).alias("class"))
    general = classes.join(best, "class").select(
        "query_id",
        "chunk_id",
        (F.when(type_intent(F.col("class"), F.col("question")), 1.5).otherwise(0.0) + 0.5 * F.col("b.confidence")).alias("score"),
        F.col("b.relation_id").alias("relation_id"),
        F.col("b.position").alias("position"),
    ).filter("score > 0")
    rows = own.unionByName(general)
    order = [F.round("score", 9).desc(), F.asc("relation_id"), F.asc("position")]
    kept = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(*order))).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit)


def undirected(edges: DataFrame) -> DataFrame:
    """Edges and their reversals."""
    back = edges.select(
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        *[c for c in edges.columns if c not in ("source", "target")],
    )
    return edges.unionByName(back)


def two_hop_scores(seeds: DataFrame, edges: DataFrame, supports: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Chunk scores ``sum(confidence * 1.2 / depth)`` of a two-level expansion.

    ``seeds(query_id, entity_id)``, ``edges(edge_id, source, target, confidence)``,
    ``supports(edge_id, chunk_id)``; ``blocked(entity_id)`` hubs never start a search.
    Every entity is expanded once per query, at the depth it is first reached. Path
    weights are summed per (query, edge) before chunks are attached, so a hub adds
    one row per edge and not one per path.
    """
    if blocked is not None:
        seeds = seeds.join(blocked.select("entity_id"), "entity_id", "left_anti")
    seeds = seeds.select("query_id", "entity_id").distinct()
    step = undirected(edges.select("edge_id", "source", "target", "confidence"))
    first = seeds.join(step, seeds["entity_id"] == step["source"]).select("query_id", "edge_id", "target", "confidence")
    reached = first.select("query_id", F.col("target").alias("entity_id")).distinct().join(
        seeds, ["query_id", "entity_id"], "left_anti"
    )
    second = reached.join(step, reached["entity_id"] == step["source"]).select("query_id", "edge_id", "confidence")
    weighted = first.select("query_id", "edge_id", (F.col("confidence") * 1.2).alias("w")).unionByName(
        second.select("query_id", "edge_id", (F.col("confidence") * (1.2 / 2)).alias("w"))
    )
    per_edge = weighted.groupBy("query_id", "edge_id").agg(F.sum("w").alias("w"))
    return per_edge.join(supports.select("edge_id", "chunk_id"), "edge_id").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


def graph_health(relations: DataFrame, entities: DataFrame, supports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of entities, relations, supports and supports whose chunk is missing."""
    missing = supports.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return entities.agg(F.count("*").alias("entities")).select(
        "entities",
        relations.agg(F.count("*").alias("n")).scalar().alias("relations"),
        supports.agg(F.count("*").alias("n")).scalar().alias("supports"),
        missing.agg(F.count("*").alias("n")).scalar().alias("missing_supports"),
    )
