"""Retrieval metrics, percentiles and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import bm25_tokens, compact_alnum
from corpusmill.operators.sparse import RANK_DIGITS  # noqa: F401

FACT_OVERLAP = 0.45


def document_recall(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: gold count, matched count, recall and any-hit; no gold gives nulls."""
    gold = gold.select("query_id", "chunk_id").distinct()
    found = hits.select("query_id", "chunk_id").distinct().join(gold, ["query_id", "chunk_id"], "left_semi")
    counts = gold.groupBy("query_id").agg(F.count("*").alias("gold_count"))
    matched = found.groupBy("query_id").agg(F.count("*").alias("matched"))
    joined = queries.select("query_id").join(counts, "query_id", "left").join(matched, "query_id", "left")
    has_gold = F.col("gold_count").isNotNull()
    return joined.select(
        "query_id",
        F.coalesce("gold_count", F.lit(0)).alias("gold_count"),
        F.when(has_gold, F.coalesce("matched", F.lit(0))).alias("matched"),
        F.when(has_gold, F.coalesce("matched", F.lit(0)) / F.col("gold_count")).alias("recall"),
        F.when(has_gold, F.coalesce("matched", F.lit(0)) > 0).alias("any_hit"),
        F.when(has_gold, F.coalesce("matched", F.lit(0)) == F.col("gold_count")).alias("complete_hit"),
    )


def part_recall(found: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Recall of documents and of their gold parts (sections or pages) per query.

    ``found`` and ``gold`` are ``(query_id, file_id, part_no)``; a query without gold
    has recall 0.
    """
    key = ["query_id", "file_id", "part_no"]
    found, gold = found.select(*key).distinct(), gold.select(*key).distinct()
    totals = gold.groupBy("query_id").agg(F.countDistinct("file_id").alias("gold_docs"), F.count("*").alias("gold_parts"))
    docs = found.select("query_id", "file_id").distinct().join(gold, ["query_id", "file_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("docs"))
    parts = found.join(gold, key, "left_semi").groupBy("query_id").agg(F.count("*").alias("parts"))
    joined = queries.select("query_id").join(totals, "query_id", "left").join(docs, "query_id", "left").join(parts, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda part, whole: F.round(F.when(zero(whole) > 0, zero(part) / F.col(whole)).otherwise(0.0), 8)
    return joined.select(
        "query_id", zero("gold_docs").alias("gold_docs"), zero("gold_parts").alias("gold_parts"), share("docs", "gold_docs").alias("document_recall"),
        share("parts", "gold_parts").alias("part_recall"), (zero("parts") > 0).alias("any_evidence_hit"),
    )


def first_hit_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    return hits.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("first_hit_rank")
    )


def fact_recall(contexts: DataFrame, facts: DataFrame) -> DataFrame:
    """Gold facts found in the joined contexts: verbatim (compacted) or 45 % of their tokens.

    ``contexts(query_id, rank, content)`` is the bounded result list of a query,
    ``facts(query_id, fact_no, fact)``.
    """
    joined = contexts.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda c: c["content"]), "\n").alias("body")
    )
    prepared = joined.select(
        "query_id", compact_alnum(F.col("body")).alias("dense"), F.array_distinct(bm25_tokens("body")).alias("have")
    )
    rows = facts.filter(F.trim("fact") != "").select(
        "query_id", "fact_no", compact_alnum(F.col("fact")).alias("fact_dense"), F.array_distinct(bm25_tokens("fact")).alias("want")
    ).join(prepared, "query_id", "left")
    overlap = F.coalesce(F.size(F.array_intersect("want", "have")), F.lit(0)) / F.greatest(F.size("want"), F.lit(1))
    hit = F.coalesce(F.contains("dense", F.col("fact_dense")), F.lit(False)) | (overlap >= FACT_OVERLAP)
    return rows.withColumn("hit", hit).groupBy("query_id").agg(
        F.count("*").alias("fact_total"), F.sum(F.col("hit").cast("long")).alias("fact_matched")
    )


def span_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def interval_union(spans: DataFrame, keys: tuple[str, ...], start: str = "start", end: str = "end") -> DataFrame:
    """Total covered length per key, overlaps counted once."""
    valid = spans.filter(F.col(end) > F.col(start))
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    added = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return valid.withColumn("_add", added).groupBy(*keys).agg(F.sum("_add").alias("covered"))


def span_metrics(retrieved: DataFrame, gold: DataFrame, union: bool = False) -> DataFrame:
    """Character recall and precision per query.

    ``retrieved(query_id, rank, file_id, start, end)``, ``gold(query_id, span_no,
    file_id, start, end)``. By default overlapping passages count twice (as the
    legal benchmark does); with ``union`` every character counts once.
    """
    g = gold.select("query_id", "span_no", "file_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    pairs = g.join(retrieved, ["query_id", "file_id"]).withColumn(
        "chars", span_overlap(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))
    ).filter("chars > 0")
    if union:
        clipped = pairs.select(
            "query_id", "span_no", F.greatest("start", "g_start").alias("start"), F.least("end", "g_end").alias("end")
        )
        relevant = interval_union(clipped, ("query_id", "span_no")).groupBy("query_id").agg(F.sum("covered").alias("relevant_chars"))
        shown = interval_union(retrieved, ("query_id", "file_id")).groupBy("query_id").agg(F.sum("covered").alias("retrieved_chars"))
    else:
        relevant = pairs.groupBy("query_id").agg(F.sum("chars").alias("relevant_chars"))
        shown = retrieved.groupBy("query_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("retrieved_chars"))
    hit = pairs.groupBy("query_id").agg(F.countDistinct("span_no").alias("spans_hit"), F.min("rank").alias("first_hit_rank"))
    totals = gold.groupBy("query_id").agg(
        F.count("*").alias("span_count"), F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("gold_chars")
    )
    joined = totals.join(shown, "query_id", "left").join(relevant, "query_id", "left").join(hit, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "query_id",
        "span_count",
        "gold_chars",
        zero("retrieved_chars").alias("retrieved_chars"),
        zero("relevant_chars").alias("relevant_chars"),
        F.when(F.col("gold_chars") > 0, zero("relevant_chars") / F.col("gold_chars")).otherwise(0.0).alias("char_recall"),
        F.when(zero("retrieved_chars") > 0, zero("relevant_chars") / F.col("retrieved_chars")).otherwise(0.0).alias("char_precision"),
        (zero("spans_hit") > 0).alias("any_hit"),
        (zero("spans_hit") == F.col("span_count")).alias("complete_hit"),
        (F.col("first_hit_rank") == 1).eqNullSafe(True).alias("rank1_hit"),
        "first_hit_rank",
    )


BUCKETS = 256


def order_statistics(values: DataFrame, value: str, keys: tuple[str, ...], positions: dict[str, Column]) -> DataFrame:
    """Exact elements at 1-based positions of each sorted group, as columns.

    ``positions`` maps an output name to a Column over ``n``, the group size. No
    group is ever sorted as a whole: equal values are counted first, approximate
    quantiles cut the value range into buckets, exact bucket counts locate the
    bucket of each position, and only that bucket is ordered. One group may
    hold most of the rows.
    """
    keys = tuple(keys) or ("_all",)
    base = values.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1)) if "_all" in keys else values.filter(F.col(value).isNotNull())
    counted = base.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    probes = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_distinct(F.percentile_approx(value, probes, 2000)).alias("_cuts")
    )
    placed = counted.join(cuts.select(*keys, "_cuts"), list(keys)).withColumn(
        "_b", F.aggregate("_cuts", F.lit(0), lambda acc, c: acc + (c < F.col(value)).cast("int"))
    ).drop("_cuts")
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    upto = F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    sizes = sizes.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_s")).join(cuts.select(*keys, "n"), list(keys))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), position.cast("long").alias("p")) for name, position in positions.items()])
    )
    located = sizes.withColumn("_w", wanted).filter((F.col("_w.p") > F.col("_from")) & (F.col("_w.p") <= F.col("_to"))).select(
        *keys, "_b", F.col("_w.name").alias("_name"), (F.col("_w.p") - F.col("_from")).alias("_offset")
    )
    rows = placed.join(located, [*keys, "_b"])
    inside = F.sum("_c").over(
        W.partitionBy(*keys, "_b", "_name").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    picked = rows.withColumn("_in", inside).filter(F.col("_in") >= F.col("_offset")).groupBy(*keys, "_name").agg(F.min(value).alias("_v"))
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions])
    return out.drop("_all")


def nearest_round_percentile(values: DataFrame, value: str, keys: tuple[str, ...] = (), p: float = 0.95, out: str = "p95") -> DataFrame:
    """Element at index ``round((n - 1) * p)``, half to even."""
    return order_statistics(values, value, keys, {out: F.bround((F.col("n") - 1) * p).cast("long") + 1})


def nearest_rank_percentile(values: DataFrame, value: str, keys: tuple[str, ...] = (), p: float = 0.95, out: str = "p95") -> DataFrame:
    """Element at rank ``ceil(p * n)``."""
    return order_statistics(values, value, keys, {out: F.greatest(F.lit(1), F.ceil(F.col("n") * p))})


def latency_summary(values: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean and linearly interpolated p50 / p95 / p99 per group."""
    points = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    positions = {}
    for name, p in points.items():
        positions[f"_{name}_lo"] = F.floor((F.col("n") - 1) * p) + 1
        positions[f"_{name}_hi"] = F.ceil((F.col("n") - 1) * p) + 1
    ranks = order_statistics(values, value, keys, positions)
    means = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    joined = means.join(ranks, list(keys))
    outs = []
    for name, p in points.items():
        lo, hi, at = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), (F.col("n") - 1) * p
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return joined.select(*keys, "n", "mean", *outs)


def breakdown(cases: DataFrame, by: str) -> DataFrame:
    """Total and per-class rates in one pass; the total row has ``scope = 'all'``."""
    rolled = cases.rollup(by).agg(
        F.grouping(by).alias("_total"),
        F.count("*").alias("n_queries"),
        F.sum(F.col("has_gold").cast("long")).alias("n_with_gold"),
        (F.sum("matched") / F.sum("gold_count")).alias("micro_recall"),
        F.avg("recall").alias("macro_recall"),
        F.avg(F.col("any_hit").cast("double")).alias("any_hit_rate"),
        F.avg(F.col("complete_hit").cast("double")).alias("complete_hit_rate"),
        F.avg("first_hit_rank").alias("mean_first_hit_rank"),
    )
    return rolled.withColumn("scope", F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(by).cast("string"))).drop("_total", by)


def variant_summary(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Score share, perfect and zero questions, mean time per (dataset, variant)."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("questions"),
        F.sum("score").alias("score"),
        F.sum("max_score").alias("max_score"),
        F.coalesce(F.try_divide(F.sum("score"), F.sum("max_score")), F.lit(0.0)).alias("accuracy"),
        F.sum((F.col("score") == F.col("max_score")).cast("long")).alias("perfect_questions"),
        F.sum((F.col("score") == 0).cast("long")).alias("zero_questions"),
        F.avg("seconds").alias("avg_seconds"),
    )


def stage_histogram(stages: DataFrame, bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """Cumulative bucket counts per pipeline stage, like a latency histogram."""
    seconds = F.col("duration_ms") / 1000.0
    return stages.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.sum(seconds).alias("total_seconds"),
        *[F.sum((seconds <= b).cast("long")).alias(f"le_{str(b).replace('.', '_')}") for b in bounds],
    )
