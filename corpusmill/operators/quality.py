"""Checks of generated answers against the contexts they were given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import numbers as N
from corpusmill.functions.text import any_contains, bm25_tokens, compact_alnum, find_all, let, strip, text_of
from corpusmill.functions.vectors import cosine
from corpusmill.operators.embed import Embedder, embed

# Refusal phrases, statements that are no claims, safe abstentions.
REFUSALS = ("根據目前檢索資料無法確認", "目前檢索資料不足", "資料不足")
REFUSALS_ANY_LANGUAGE = REFUSALS + (
    "insufficient information", "cannot determine", "cannot be determined", "not enough information",
)
EXPLICIT_BINARY = (
    r"(?iU)^(?:答案|結論)?\s*(?:是|不是|否|對|不對|並非|不完全正確|不能說)(?:[。！？；：:，,\s]|$)",
    r"(?iU)^(?:答案|結論)?\s*(?:為|是)?\s*[:：]?\s*(?:yes|no)\b",
    r"(?iU)^(?:答案|結論)?\s*(?:並非如此|不能說沒有變化|不完全正確)",
)
SOURCE_ONLY = r"^(?:來源|資料來源|引用|參考資料)\s*[：:]?\s*(?:\[\d+\]\s*[,，、]?\s*)+$"
META_CLAIM = (
    r"^(?:(?:兩者|二者|兩個版本)?(?:相同|一樣|一致|未改變|沒有改變|無異動)|相較之下|綜上|總結|因此|可見)[了。！!？?：:]*$"
)
ABSTENTION = r"無法確認|資料不足|無法判斷|未能確認"
INFERENCE = (
    r"^(?:相同|一樣|一致|兩者|二者|兩版|兩個版本|因此|所以|綜上|總結|可見)|"
    r"(?:未見|未保留|沒有|並無|不具|不存在|差異|異同|相較)"
)
LABELS = ("回答：", "答案：", "依據：", "參考資料：")
SEGMENT = r"[\r\n]+|(?<=[。！？；])"
NO_HEAD = r"(?i)^(?:答案|結論)?\s*(?:為|是)?\s*[:：]?\s*(?:no|否|不是|並非|不完全正確|不能說|不成立|不對)"
YES_HEAD = r"(?i)^(?:答案|結論)?\s*(?:為|是)?\s*[:：]?\s*(?:yes|是|對|正確|符合|同意|一致)"
NO_LATER = r"(?i)(?:並非如此|不完全正確|不能說沒有變化|答案\s*(?:為|是)?\s*(?:否|no)|結論\s*(?:為|是)?\s*(?:否|no))"
YES_LATER = r"(?i)(?:答案\s*(?:為|是)?\s*(?:是|yes)|結論\s*(?:為|是)?\s*(?:是|yes))"
NORMAL_DROP = r"(?U)[\s\x{3000}，。；：、！？（）()「」『』\[\],.!?]"

SEMANTIC_THRESHOLD = 0.50
LEXICAL_THRESHOLD = 0.12


def cited_ranks(answer: Column) -> Column:
    """Distinct ``[n]`` markers in order of appearance."""
    return F.array_distinct(F.transform(find_all(answer, r"\[(\d+)\]", 1), lambda d: d.try_cast("int")))


def is_refusal(answer: Column) -> Column:
    return any_contains(text_of(answer), REFUSALS)


def is_total_refusal(answer: Column) -> Column:
    """Refusal in the opening, unless the answer starts with a clear yes or no."""
    head = F.substring(F.lower(strip(text_of(answer))), 1, 320)
    clear = F.lit(False)
    for pattern in EXPLICIT_BINARY:
        clear = clear | head.rlike(pattern)
    return ~clear & any_contains(head, REFUSALS_ANY_LANGUAGE)


def normalized(value: Column) -> Column:
    return F.lower(F.regexp_replace(text_of(value), NORMAL_DROP, ""))


def validate_citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """``passed`` / ``failed`` / ``refused`` per answer with valid and invalid ranks.

    ``answers(run_id, answer)``, ``contexts(run_id, rank, content)``.
    """
    known = contexts.filter(strip(text_of("content")) != "").select("run_id", "rank").distinct()
    markers = answers.select("run_id", F.posexplode(cited_ranks(F.col("answer"))).alias("pos", "rank"))
    tagged = markers.join(known.withColumn("known", F.lit(True)), ["run_id", "rank"], "left")
    # Markers of one answer: bounded by the answer itself.
    ordered = lambda cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "rank")))), lambda s: s["rank"]
    )
    grouped = tagged.groupBy("run_id").agg(
        ordered(F.col("known").isNotNull()).alias("valid"), ordered(F.col("known").isNull()).alias("invalid")
    )
    empty = F.array().cast("array<int>")
    joined = answers.join(grouped, "run_id", "left").withColumn("valid", F.coalesce("valid", empty)).withColumn(
        "invalid", F.coalesce("invalid", empty)
    )
    refused = is_refusal(F.col("answer"))
    sufficient = (F.size("valid") > 0) & (F.size("invalid") == 0)
    return joined.select(
        "run_id",
        "answer",
        F.when(refused, "refused").when(sufficient, "passed").otherwise("failed").alias("status"),
        (refused | sufficient).alias("sufficient"),
        F.when(refused, empty).otherwise(F.col("valid")).alias("valid_citations"),
        F.when(refused, empty).otherwise(F.col("invalid")).alias("invalid_citations"),
        F.when(refused, F.array().cast("array<string>")).otherwise(uncited_claims(F.col("answer"))).alias("uncited_claims"),
    )


def uncited_claims(answer: Column) -> Column:
    lines = F.transform(
        F.split(strip(text_of(answer)), SEGMENT, -1), lambda s: strip(F.regexp_replace(s, r"(?U)^\s*[-•*#]+\s*", ""))
    )
    kept = F.filter(
        lines,
        lambda s: (s != "") & ~F.contains(s, F.lit("來源：")) & ~s.rlike(r"^\[\d+\](?:\s*[,，、]\s*\[\d+\])*$") & ~F.contains(s, F.lit("[")),
    )
    return kept


def grounded_answer(status: Column, answer: Column, fallback: str) -> Column:
    """Fail closed: an answer that did not pass is replaced."""
    return F.when(status.isin("refused", "passed"), strip(text_of(answer))).otherwise(F.lit(fallback))


def citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Cited contexts with a digest of their content; unknown ranks yield no row."""
    markers = answers.select("run_id", F.posexplode(cited_ranks(F.col("answer"))).alias("pos", "rank"))
    return markers.join(contexts, ["run_id", "rank"]).withColumn("content_sha256", F.sha2(text_of("content"), 256))


def claims(answer: Column) -> Column:
    """``array<struct<claim,ranks>>``: all substantive statements, whole."""

    def tidy(raw: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s*[-•*#]+\s*", ""), r"[*_`]+", "")
        return strip(F.regexp_replace(strip(plain), r"\[(\d+)\]", ""))

    def keep(raw: Column) -> Column:
        bare = strip(F.regexp_replace(raw, r"(?U)^\s*[-•*#]+\s*", ""))
        return (raw != "") & ~raw.rlike(SOURCE_ONLY) & ~bare.rlike(r"^[|\-: ]+$") & ~raw.rlike(r"^\*{1,3}.+\*{1,3}$")

    raws = F.filter(F.transform(F.split(text_of(answer), SEGMENT, -1), strip), keep)
    rows = F.transform(
        raws,
        lambda raw: F.struct(
            tidy(raw).alias("claim"),
            F.transform(F.regexp_extract_all(raw, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda d: d.try_cast("int")).alias("ranks"),
        ),
    )
    return F.filter(
        rows,
        lambda r: (F.length(r["claim"]) >= 3) & ~r["claim"].isin(*LABELS) & ~r["claim"].rlike(META_CLAIM) & ~r["claim"].rlike(ABSTENTION),
    )


def claim_support(
    answers: DataFrame,
    contexts: DataFrame,
    factory: Callable[[], Embedder] | None = None,
    semantic_threshold: float = SEMANTIC_THRESHOLD,
) -> DataFrame:
    """Best lexical (and optional semantic) support of every claim within its own run.

    Claims meet contexts by ``run_id``; both sides are bounded per run.
    """
    rows = answers.select("run_id", F.posexplode(claims(F.col("answer"))).alias("claim_no", "c")).select(
        "run_id", "claim_no", F.col("c.claim").alias("claim"), F.array_distinct(bm25_tokens("c.claim")).alias("want")
    )
    texts = contexts.select("run_id", "rank", F.concat_ws("\n", text_of("title"), text_of("content")).alias("body")).select(
        "run_id", "rank", "body", F.array_distinct(bm25_tokens("body")).alias("have"), normalized(F.col("body")).alias("dense")
    )
    if factory is not None:
        rows = rows.withColumn("cv", embed(F.col("claim"), factory))
        texts = texts.withColumn("tv", embed(F.col("body"), factory))
    joined = rows.join(texts, "run_id", "left")
    lexical = F.coalesce(F.size(F.array_intersect("want", "have")), F.lit(0)) / F.greatest(F.size("want"), F.lit(1))
    semantic = F.coalesce(cosine(F.col("cv"), F.col("tv")), F.lit(0.0)) if factory is not None else F.lit(0.0)
    verbatim = F.coalesce(F.contains("dense", normalized(F.col("claim"))), F.lit(False))
    best = joined.groupBy("run_id", "claim_no", "claim").agg(
        F.greatest(F.max(lexical), F.lit(0.0)).alias("max_lexical"),
        F.greatest(F.max(semantic), F.lit(0.0)).alias("max_semantic"),
        F.max(verbatim).alias("verbatim"),
    )
    return best.withColumn(
        "supported",
        F.col("verbatim") | (F.col("max_lexical") >= LEXICAL_THRESHOLD) | (F.col("max_semantic") >= semantic_threshold),
    )


def unsupported_numbers(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Number tokens of an answer whose value and unit no context shows."""
    bare = F.regexp_replace(text_of("answer"), r"\[\d+\]", "")
    said = answers.select("run_id", F.array_distinct(N.number_tokens(bare)).alias("tokens")).withColumn("keys", N.number_keys("tokens"))
    said = said.select("run_id", F.explode(F.arrays_zip("tokens", "keys")).alias("z")).select(
        "run_id", F.col("z.tokens").alias("token"), F.col("z.keys").alias("key")
    )
    shown = contexts.select("run_id", N.number_tokens(F.col("content")).alias("tokens")).withColumn("keys", N.number_keys("tokens"))
    shown = shown.select("run_id", F.explode("keys").alias("key")).distinct()
    return said.join(shown, ["run_id", "key"], "left_anti").select("run_id", "token")


def answer_quality(answers: DataFrame, contexts: DataFrame, factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """One row per run: claim support share, unsupported numbers, hallucination flag.

    ``answers`` may carry ``expected_facts``; when answer and contexts hold all of
    them and a citation is valid, inference sentences count as supported.
    """
    checked = validate_citations(answers, contexts)
    support = claim_support(answers, contexts, factory)
    if "expected_facts" in answers.columns:
        facts = answers.select("run_id", "answer", F.explode("expected_facts").alias("fact")).filter(strip(F.col("fact")) != "")
        bodies = contexts.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(normalized(F.col("content")))), "\n").alias("dense"))
        complete = (
            facts.join(bodies, "run_id", "left")
            .groupBy("run_id")
            .agg(
                F.min(
                    F.contains(normalized(F.col("answer")), normalized(F.col("fact")))
                    & F.coalesce(F.contains("dense", normalized(F.col("fact"))), F.lit(False))
                ).alias("facts_complete")
            )
        )
        support = (
            support.join(complete, "run_id", "left")
            .join(checked.select("run_id", (F.size("valid_citations") > 0).alias("cited")), "run_id")
            .withColumn(
                "supported",
                F.col("supported") | (F.coalesce("facts_complete", F.lit(False)) & F.col("cited") & F.col("claim").rlike(INFERENCE)),
            )
        )
    per_run = support.groupBy("run_id").agg(
        F.count("*").alias("claim_count"), F.sum(F.col("supported").cast("long")).alias("supported_count")
    )
    odd = unsupported_numbers(answers, contexts).groupBy("run_id").agg(F.count("*").alias("unsupported_numbers"))
    joined = checked.join(per_run, "run_id", "left").join(odd, "run_id", "left").fillna(
        0, ["claim_count", "supported_count", "unsupported_numbers"]
    )
    refused = F.col("status") == "refused"
    wrong = (
        (F.col("supported_count") < F.col("claim_count")) | (F.col("unsupported_numbers") > 0) | (F.size("invalid_citations") > 0)
    )
    return joined.select(
        "run_id",
        "status",
        "claim_count",
        "supported_count",
        "unsupported_numbers",
        F.size("invalid_citations").alias("invalid_citations"),
        F.when(refused | (F.col("claim_count") == 0), 0.0).otherwise(F.col("supported_count") / F.col("claim_count")).alias("evidence_score"),
        (~refused & (F.col("claim_count") > 0) & ~wrong).alias("evidence_passed"),
        (~refused & wrong).alias("hallucination"),
    )


def matches_gold(answer: Column, gold: Column) -> Column:
    """Answer-level correctness for yes/no, refusal and short-text gold answers."""
    text, expected = strip(text_of(answer)), strip(text_of(gold))
    kind = F.lower(expected)
    head = F.substring(strip(F.element_at(F.split(text, r"[\r\n。！？；;]", 2), 1)), 1, 320)
    leading = F.substring(text, 1, 500)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    wanted = F.filter(words(expected), lambda t: F.length(t) > 1)
    subset = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words(text))) == 0)
    contained = (compact_alnum(expected) != "") & F.contains(compact_alnum(text), compact_alnum(expected))
    return (
        F.when(expected == "", False)
        .when(kind == "insufficient information.", is_total_refusal(text))
        .when(kind == "no", head.rlike(NO_HEAD) | leading.rlike(NO_LATER))
        .when(kind == "yes", head.rlike(YES_HEAD) | leading.rlike(YES_LATER))
        .otherwise(contained | subset)
    )


def groups_score(answer: Column, required: Column, forbidden: Column) -> Column:
    """Share of required any-of groups, 0 when a forbidden phrase or a refusal occurs."""
    dense = normalized(answer)
    hit = let(dense, lambda d: F.size(F.filter(required, lambda group: F.exists(group, lambda t: F.contains(d, normalized(t))))))
    bad = let(
        dense,
        lambda d: F.exists(F.coalesce(forbidden, F.array().cast("array<string>")), lambda t: F.contains(d, normalized(t)))
        | F.contains(d, F.lit(REFUSALS[0])),
    )
    return F.when(bad, 0.0).otherwise(F.round(hit / F.greatest(F.size(required), F.lit(1)) * 100, 1))


def any_of(answer: Column, group: Column) -> Column:
    return let(normalized(answer), lambda d: F.exists(group, lambda t: F.contains(d, normalized(t))))


def all_of(answer: Column, terms: Column) -> Column:
    return let(normalized(answer), lambda d: F.forall(terms, lambda t: F.contains(d, normalized(t))))


def criteria_score(contexts: DataFrame, criteria: DataFrame, cap: DataFrame | None = None) -> DataFrame:
    """Weights of the criteria with any alias in the joined contexts, capped at the item maximum.

    ``contexts(query_id, rank, parent_title, title, content)``, ``criteria(query_id,
    label, weight, aliases)``.
    """
    body = contexts.groupBy("query_id").agg(
        F.array_join(
            F.array_sort(F.collect_list(normalized(F.concat_ws("\n", text_of("parent_title"), text_of("title"), text_of("content"))))), "\n"
        ).alias("dense")
    )
    rows = criteria.join(body, "query_id", "left")
    hit = F.exists("aliases", lambda a: (normalized(a) != "") & F.contains(F.col("dense"), normalized(a)))
    scored = rows.groupBy("query_id").agg(
        F.sum(F.when(F.coalesce(hit, F.lit(False)), F.coalesce("weight", F.lit(1))).otherwise(0)).alias("raw"),
        F.sum(F.coalesce("weight", F.lit(1))).alias("max_score"),
    )
    if cap is not None:
        scored = scored.drop("max_score").join(cap.select("query_id", "max_score"), "query_id")
    return scored.select("query_id", F.least("raw", "max_score").alias("score"), "max_score")


def strict_citation_gate(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every substantive sentence must end in a citation of a known rank."""
    checked = validate_citations(answers, contexts)
    segments = answers.select(
        "run_id",
        F.explode(F.split(strip(text_of("answer")), r"(?U)(?<=[。！？；!?])(?=\s+|$)|\r?\n+", -1)).alias("s"),
    ).select("run_id", strip(F.regexp_replace(strip(F.col("s")), r"(?U)^\s*[-•*#]+\s*", "")).alias("s"))
    bare = strip(F.regexp_replace("s", r"\[(\d+)\]", ""))
    boundary = r"根據目前檢索資料無法確認|目前檢索資料不足|資料不足|缺少(?:的)?證據"
    meta = (
        (bare == "")
        | bare.rlike(r"^(?:來源|資料來源|引用|參考資料)\s*[：:]?.*$")
        | bare.rlike(r"^(?:[-•]|\d+[.)])?\s*(?:缺少|不足|無法確認|資料不足|沒有提供).{0,260}$")
        | (bare.rlike(boundary) & (F.length(F.regexp_replace(F.regexp_replace(bare, boundary, ""), r"^[ ：:，,。；]+|[ ：:，,。；]+$", "")) < 8))
    )
    substantive = segments.filter((F.col("s") != "") & ~meta)
    ended = F.regexp_replace("s", r"[。！？；!?]+$", "").rlike(r"(?:\[\d+\]\s*)+$")
    issues = substantive.groupBy("run_id").agg(
        F.count("*").alias("substantive"), F.sum((~ended).cast("long")).alias("open_sentences")
    )
    joined = checked.join(issues, "run_id", "left").fillna(0, ["substantive", "open_sentences"])
    clean = F.size("invalid_citations") == 0
    return joined.select(
        "run_id",
        "substantive",
        "open_sentences",
        F.when(F.col("substantive") == 0, clean)
        .otherwise(clean & (F.col("open_sentences") == 0) & (F.size("valid_citations") > 0))
        .alias("passed"),
    )


def judge_score(score: Column, contradicts: Column, unsupported: Column, failed_abstention: Column) -> Column:
    """Judge total under its caps: contradiction 49, critical unsupported claim 59, missed abstention 40."""
    cap = F.least(
        F.when(contradicts, 49.0).otherwise(100.0),
        F.when(unsupported, 59.0).otherwise(100.0),
        F.when(failed_abstention, 40.0).otherwise(100.0),
    )
    return F.least(score.cast("double"), cap)


def dimension_scores(given: DataFrame, rubric: DataFrame) -> DataFrame:
    """Judge dimensions clamped to the rubric; a missing dimension counts 0."""
    return rubric.join(given, "dimension", "left").select(
        "dimension", "maximum", F.least(F.col("maximum").cast("double"), F.greatest(F.lit(0.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0)))).alias("score")
    )


def alignment(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested articles per item: how many the context holds and how many it lacks."""
    want = requested.select("item_id", "article").distinct()
    have = found.select("item_id", "article").distinct().withColumn("hit", F.lit(1))
    return want.join(have, ["item_id", "article"], "left").groupBy("item_id").agg(
        F.count("*").alias("requested"), F.sum(F.coalesce("hit", F.lit(0))).alias("found")
    ).withColumn("missing", F.col("requested") - F.col("found"))


def answer_summary(cases: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pass rates over answered questions."""
    rates = [F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in cases.columns if dict(cases.dtypes)[c] == "boolean"]
    return cases.groupBy(*keys).agg(F.count("*").alias("n"), *rates)
