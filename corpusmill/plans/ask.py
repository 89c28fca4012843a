"""Answering a batch of questions from retrieved evidence.

The text generator is a seam: without one, only threshold answers and refusals
are produced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.operators import evidence, planning, quality
from corpusmill.operators.embed import Embedder, Generator, generate, hashing_embedder
from corpusmill.operators.expansion import normalize_contexts
from corpusmill.operators.rerank import attention_order
from corpusmill.plans.retrieve import Corpus, gated, retrieve
from corpusmill.session import stage

# Answers given when evidence is missing or not cited.
REFUSAL = "根據目前檢索資料無法確認。"
UNGROUNDED = "根據目前檢索資料無法確認。模型產生的答案沒有通過來源約束檢查，因此系統未顯示未受證據支持的內容。"


def prompts(questions: DataFrame, contexts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One prompt per question with its evidence in edge order (best first and last)."""
    shown = normalize_contexts(contexts)
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content"))
    parts = shown.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(attention_order(F.col("rank")).alias("o"), block.alias("b")))), lambda s: s["b"]), "\n\n"
        ).alias("evidence")
    )
    joined = questions.join(parts, "query_id")
    if history is not None:
        joined = joined.join(history.select("query_id", "history"), "query_id", "left")
    past = F.concat(F.coalesce(F.col("history"), F.lit("")), F.lit("\n")) if history is not None else F.lit("")
    return joined.select("query_id", F.concat(past, F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), "evidence").alias("prompt"))


def clock_answer(question: Column, now: Column, zone: str = "Asia/Taipei") -> Column:
    """Date or time in the local zone for a clock question, else null."""
    local = F.from_utc_timestamp(now, zone)
    date = F.concat(F.year(local), F.lit(" 年 "), F.month(local), F.lit(" 月 "), F.day(local), F.lit(" 日"))
    wants_time = F.col("question").rlike("幾點|什麼時間|現在時間|目前時間")
    return F.when(
        planning.asks_clock(question), F.when(wants_time, F.concat(F.lit("現在是 "), date, F.date_format(local, " HH:mm"))).otherwise(F.concat(F.lit("今天是 "), date))
    )


def refined(questions: DataFrame, contexts: DataFrame, settings: Settings, embedder: Callable[[], Embedder] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Contexts after the fine or focused second pass of the settings, and their gate.

    Questions whose contexts pass the gate only as they were retrieved keep those.
    """
    contexts = stage(contexts, "contexts")  # gate, thresholds, prompts and citations read them
    gate = gated(questions, contexts, settings)
    if settings.fine_evidence_enabled:
        parts = evidence.fine_contexts(
            contexts, questions, settings.fine_evidence_chunk_fraction, settings.fine_evidence_chunk_chars, settings.fine_evidence_overlap_chars, settings.fine_evidence_top_k,
            settings.fine_evidence_max_groups, settings.fine_evidence_keyword_weight, settings.fine_evidence_embedding_weight, settings.fine_evidence_min_embedding_score, embedder,
        )
    elif settings.evidence_focus_enabled:
        parts = evidence.focus_contexts(
            contexts, questions, settings.evidence_focus_top_k, settings.evidence_focus_max_chars, settings.evidence_focus_keyword_weight, settings.evidence_focus_embedding_weight, embedder
        )
    else:
        return contexts, gate
    parts = stage(parts, "refined")
    own = stage(gated(questions, parts, settings), "gate")
    worse = stage(gate.where("sufficient").join(own.where("NOT sufficient").select("query_id"), "query_id", "left_semi"), "guarded")
    lost = worse.select("query_id")
    kept = parts.join(lost, "query_id", "left_anti").unionByName(contexts.join(lost, "query_id", "left_semi"), allowMissingColumns=True)
    return kept, own.join(lost, "query_id", "left_anti").unionByName(worse)


def answer(
    questions: DataFrame,
    corpus: Corpus,
    settings: Settings | None = None,
    generator: Callable[[], Generator] | None = None,
    **options,
) -> DataFrame:
    """``query_id, route, answer, status, citations`` for every question.

    Questions that need no retrieval skip it, threshold questions are answered
    from a range line, gated ones are refused, the rest go to the generator and
    must cite retrieved ranks to be shown.
    """
    settings = (settings or Settings()).normalized()
    routed = questions.withColumn("decision", planning.retrieval_decision(F.col("question")))
    direct = routed.filter("decision = 'direct'").select("query_id", F.lit("direct").alias("route"), F.lit(None).cast("string").alias("answer"))
    asked = routed.filter("decision <> 'direct'").drop("decision")
    contexts, gate = refined(asked, retrieve(asked, corpus, settings, **options), settings, options.get("embedder", hashing_embedder))
    resolved = evidence.resolve_threshold(asked, contexts).select(
        "query_id",
        F.lit("threshold").alias("route"),
        F.concat(F.lit("依檢索資料，"), F.col("line"), F.lit("\n\n來源：["), F.col("rank"), F.lit("]")).alias("answer"),
    )
    open_questions = asked.join(resolved.select("query_id"), "query_id", "left_anti").join(gate.select("query_id", "sufficient"), "query_id")
    refused = open_questions.filter("NOT sufficient").select("query_id", F.lit("refused").alias("route"), F.lit(REFUSAL).alias("answer"))
    ready = open_questions.filter("sufficient").drop("sufficient")
    made = resolved.unionByName(refused)
    if generator is not None:
        written = prompts(ready, contexts).select("query_id", F.lit("generated").alias("route"), generate(F.col("prompt"), generator).alias("answer"))
    else:
        written = ready.select("query_id", F.lit("no_generator").alias("route"), F.lit(REFUSAL).alias("answer"))
    made = made.unionByName(written)
    checked = quality.validate_citations(
        made.withColumnRenamed("query_id", "run_id"), contexts.select(F.col("query_id").alias("run_id"), "rank", "content")
    )
    final = checked.select(
        F.col("run_id").alias("query_id"), "status", quality.grounded_answer(F.col("status"), F.col("answer"), UNGROUNDED).alias("answer"), "valid_citations"
    ).join(made.select("query_id", "route"), "query_id")
    empty = F.array().cast("array<int>")
    skipped = direct.select("query_id", F.lit("direct").alias("status"), "answer", empty.alias("valid_citations"), "route")
    return final.unionByName(skipped)


def should_retry(attempt: int, max_attempts: int, supported_passages: Column, answer_supported: Column, answer_retry: Column, utility: Column, utility_retry: Column) -> Column:
    """Another attempt is due when no passage supports, the answer is unsupported, or it is of little use."""
    if attempt >= max_attempts:
        return F.lit(False)
    return (supported_passages == 0) | answer_retry | ~answer_supported | utility_retry | (utility <= 2)


def reflections(output: Column, chunk_count: Column) -> Column:
    """``array<struct<chunk,relevant,supported>>`` from critic lines ``n: label label``; missing chunks are neither."""
    rows = F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(r"(?m)^\s*\[?(\d+)\]?\s*[:：].*$"), F.lit(0))
    return F.transform(
        F.sequence(F.lit(1), chunk_count),
        lambda n: F.struct(
            n.alias("chunk"),
            F.exists(rows, lambda r: (F.regexp_extract(r, r"(\d+)", 1) == n.cast("string")) & F.lower(r).rlike(r"\brelevant\b")).alias("relevant"),
            F.exists(
                rows, lambda r: (F.regexp_extract(r, r"(\d+)", 1) == n.cast("string")) & F.lower(r).rlike(r"(?<!un)(?<!partially )\bsupported\b|fully")
            ).alias("supported"),
        ),
    )


def answer_with_retries(
    questions: DataFrame,
    corpus: Corpus,
    generator: Callable[[], Generator],
    retry_query: Callable[[DataFrame], DataFrame],
    settings: Settings | None = None,
    max_attempts: int = 2,
    **options,
) -> DataFrame:
    """Answer, then re-ask only the failed questions with a rewritten query.

    At most three attempts; each one is a batch job over the questions left.
    """
    attempts = max(1, min(int(max_attempts), 3))
    kept, left = None, questions
    for number in range(1, attempts + 1):
        done = answer(left, corpus, settings, generator, **options).withColumn("attempt", F.lit(number))
        good = done if number == attempts else done.filter("status <> 'failed'")
        kept = good if kept is None else kept.unionByName(good)
        if number < attempts:
            failed = done.filter("status = 'failed'").select("query_id")
            left = retry_query(left.join(failed, "query_id", "left_semi"))
    return kept
