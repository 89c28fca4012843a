"""Is the retrieved evidence enough? A cascade whose costly stage sees only what is left.

Per question: nothing retrieved; evidence lines that share terms with the question;
event fields that answer it; scores of the best chunk; and for the rest a model that
is asked to judge. Every stage passes on only the questions it did not decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import find_all, strip, text_of
from corpusmill.operators import evidence
from corpusmill.operators.embed import Generator, generate
from corpusmill.operators.planning import focus_terms
from corpusmill.session import stage

# Words that say nothing about a question's subject, and reasons.
STOP_TERMS = ("什麼", "為什麼", "如何", "哪些", "哪一項", "主要", "小說", "遊戲", "文明", "問題", "背景", "來源", "目前", "確認")
LONGEST_TERM, SHOWN_SPANS = 18, 5
OVERLAP_REASON = "deterministic_evidence: query and alias terms overlap retrieved evidence"
EVENT_REASON = "deterministic_evidence: structured event fields directly support the answer"
VERDICT = "is_answerable boolean, is_related boolean, confidence double, evidence_spans array<string>, missing_info array<string>, reason string"


def evidence_terms(question: Column) -> Column:
    """Focus terms of a question and its runs of letters, digits or CJK."""
    runs = F.filter(find_all(question, r"[\x{4e00}-\x{9fff}A-Za-z0-9·]{2,}"), lambda t: ~t.isin(*STOP_TERMS) & (F.length(t) <= LONGEST_TERM))
    return F.array_distinct(F.concat(focus_terms(question), runs))


def shares_terms(line: Column, terms: Column) -> Column:
    """One term of four characters or more, or two terms, stand in ``line``."""
    hits = F.filter(terms, lambda t: F.contains(line, t))
    return F.exists(hits, lambda t: F.length(t) >= 4) | (F.size(hits) >= 2)


def line_evidence(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """``query_id, overlap (spans), event (spans), is_event`` from ``lines(query_id, position, line)``.

    Only bullet lines count; the lines of a question meet by its id.
    """
    bullets = lines.select("query_id", "position", strip(F.col("line")).alias("line")).where("startswith(line, '- ')")
    asked = questions.select("query_id", evidence_terms(F.col("question")).alias("terms"), evidence.evidence_policy(F.col("question")).alias("policy"))
    kv = F.col("kv")
    rows = bullets.join(asked, "query_id").withColumn("kv", evidence.split_key_value(F.col("line")))
    keyed = F.col("kv.key") != ""
    marks = rows.select(
        "query_id", "position", "line", "policy", shares_terms(F.col("line"), F.col("terms")).alias("shared"),
        (keyed & evidence.is_result(kv)).alias("result"), (keyed & evidence.is_participant(kv)).alias("participant"), (keyed & evidence.is_detail(kv)).alias("detail"),
    )
    listed = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("position", "line")))), lambda s: s["line"])
    grouped = marks.groupBy("query_id").agg(
        F.slice(listed(F.col("shared")), 1, SHOWN_SPANS).alias("overlap"),
        listed(F.col("result") | F.col("participant") | F.col("detail")).alias("event"),
        F.max("result").alias("result"), F.max("participant").alias("participant"), F.max("detail").alias("detail"), F.first("policy").alias("policy"),
    )
    p = F.col("policy")
    answers = p["event_or_result"] & F.col("result") & (~p["asks_participant"] | F.col("participant")) & (~p["asks_detail"] | F.col("detail"))
    return grouped.select("query_id", "overlap", "event", answers.alias("is_event"))


def prompt(question: Column, contents: Column, facts: Column) -> Column:
    return F.concat(
        F.lit("Does the evidence answer the question? Reply with JSON: is_answerable, confidence, evidence_spans, missing_info, reason.\n\nQuestion: "),
        question, F.lit("\n\nFound lines:\n"), facts, F.lit("\n\nChunks:\n"), contents,
    )


def parsed_verdict(output: Column) -> Column:
    """Verdict of a model's reply; one that is no JSON decides against the evidence."""
    read = F.from_json(F.regexp_extract(text_of(output), r"(?s)\{.*\}", 0), VERDICT)
    yes = F.coalesce(read["is_answerable"], F.lit(False))
    return F.struct(
        F.coalesce(read["is_related"], yes).alias("is_related"), yes.alias("is_answerable"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(read["confidence"], F.lit(0.0)))).alias("confidence"),
        F.coalesce(read["evidence_spans"], F.array().cast("array<string>")).alias("evidence_spans"), F.coalesce(read["missing_info"], F.array().cast("array<string>")).alias("missing_info"),
        F.coalesce(read["reason"], F.lit("the verifier gave no readable verdict")).alias("reason"),
    )


def verify_retrieval(
    questions: DataFrame, contexts: DataFrame, lines: DataFrame, judge: Callable[[], Generator] | None = None, auto_accept: bool = False,
    accept_score: float = 0.52, reject_score: float = 0.15, min_keyword: float = 8.0, min_embedding: float = 0.35, chars: int = 1200,
) -> DataFrame:
    """``query_id, stage, is_related, is_answerable, confidence, evidence_spans, missing_info, reason``.

    ``contexts(query_id, rank, content, score, keyword_score, embedding_score)``. Without
    a ``judge`` the questions left to it have stage ``open`` and null verdicts.
    """
    none = F.array().cast("array<string>")
    top = contexts.groupBy("query_id").agg(F.min_by(F.struct("score", "keyword_score", "embedding_score"), "rank").alias("best")).select("query_id", "best.*")
    scored = evidence.retrieval_confidence(top, auto_accept, accept_score, reject_score, min_keyword, min_embedding).select(
        "query_id", "decision", F.col("confidence").alias("score_confidence")
    )
    found = questions.join(scored, "query_id", "left").join(line_evidence(questions, lines), "query_id", "left")
    case = (
        F.when(F.col("decision").isNull(), "nothing").when(F.size(F.coalesce("overlap", none)) > 0, "overlap").when(F.coalesce("is_event", F.lit(False)), "event")
        .when(F.col("decision") == "accept", "accept").when(F.col("decision") == "reject", "reject").otherwise("open")
    )
    judged = stage(found.withColumn("stage", case), "verified")
    s = F.col("stage")
    good = s.isin("overlap", "event", "accept")
    decided = judged.where("stage <> 'open'").select(
        "query_id", "stage", good.alias("is_related"), good.alias("is_answerable"),
        F.when(s == "overlap", 0.85).when(s == "event", 0.95).when(s == "nothing", 0.0).otherwise(F.col("score_confidence")).alias("confidence"),
        F.when(s == "overlap", F.col("overlap")).when(s == "event", F.col("event")).otherwise(none).alias("evidence_spans"),
        F.when(s == "nothing", F.array(F.lit("no retrieved chunks"))).otherwise(none).alias("missing_info"),
        F.when(s == "overlap", OVERLAP_REASON).when(s == "event", EVENT_REASON).when(s == "nothing", "no retrieved chunks").otherwise(F.concat(F.lit("auto_"), s)).alias("reason"),
    )
    left = judged.where("stage = 'open'").select("query_id", "question", "stage")
    if judge is None:
        blank = left.select(
            "query_id", "stage", F.lit(None).cast("boolean").alias("is_related"), F.lit(None).cast("boolean").alias("is_answerable"), F.lit(None).cast("double").alias("confidence"),
            none.alias("evidence_spans"), none.alias("missing_info"), F.lit("no verifier").alias("reason"),
        )
        return decided.unionByName(blank)
    # Contexts and lines of the questions left, and only theirs, become prompts.
    text = lambda df, order, body, name: df.join(left.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.substring(text_of(body), 1, chars).alias("b")))), lambda r: r["b"]), "\n").alias(name)
    )
    asked = left.join(text(contexts, "rank", "content", "contents"), "query_id").join(text(lines, "position", "line", "facts"), "query_id", "left")
    replies = stage(asked.select("query_id", generate(prompt(F.col("question"), F.col("contents"), F.coalesce("facts", F.lit(""))), judge).alias("output")), "verdicts")
    return decided.unionByName(replies.select("query_id", F.lit("model").alias("stage"), parsed_verdict(F.col("output")).alias("v")).select("query_id", "stage", "v.*"))
