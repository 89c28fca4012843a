"""Question analysis: complexity, intents, focus terms, variants, aliases, routing.

Rules are marker lists of the retrieval contract; every rule is a Column
expression over a whole table of questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import (
    any_contains,
    bm25_tokens,
    clean_spaces,
    compact,
    contained_terms,
    find_all,
    let,
    multi_ngrams,
    strip,
    text_of,
)
from corpusmill.operators.embed import Embedder, embed, hashing_embedder
from corpusmill.functions.vectors import cosine

# Markers of the complexity score.
CLAUSE_MARKERS = ("以及", "並且", "同時", "分別", "另外", "此外", "還有", "且", "及", "與", "和", "或", "、", ",", "；", ";")
COMPLEX_MARKERS = (
    "比較", "差異", "不同", "各自", "為什麼", "為何", "原因", "如何影響", "如果", "條件", "例外", "流程", "步驟", "先", "再",
)
DEFINITION_PATTERN = r"(?i)(?:是什麼|什麼意思|代表什麼|定義|全名|meaning|define)"
ACRONYM_PATTERN = r"(?U)\b[A-Z][A-Z0-9-]{2,12}\b"

# Markers of the relation / hybrid / content classes.
RELATION_MARKERS = (
    "屬於", "属于", "哪一派", "哪派", "哪些人", "成員", "成员", "關係", "关系", "組織", "组织", "派別", "派别", "誰是", "谁是",
)
HYBRID_MARKERS = ("為什麼", "为什么", "如何", "怎麼", "怎么", "導致", "导致", "建立", "阻止", "影響", "影响")
CONTENT_MARKERS = ("是什麼", "是什么", "什麼是", "什么是", "定義", "定义", "意思", "解釋", "解释")

# Intent labels, their markers and the search terms they add.
INTENTS = (
    ("cause", ("為什麼", "為何", "原因", "怎麼會", "如何影響"), ("原因", "背景", "導致", "因為", "所以", "影響", "結果")),
    ("method", ("如何", "怎麼", "透過", "方式", "方法"), ("方式", "方法", "過程", "透過", "經由", "使用")),
    (
        "failure_reason",
        ("失敗", "錯", "錯誤", "證明", "被證明", "不成立", "模型"),
        ("失敗", "錯誤", "不成立", "被證明", "模型", "假設", "缺陷", "預測"),
    ),
    (
        "explanation",
        ("說明", "表明", "代表", "意味", "實驗", "比喻"),
        ("說明", "表明", "代表", "意味", "實驗", "比喻", "問題"),
    ),
    ("comparison", ("不同", "差異", "相比", "比較"), ("不同", "差異", "判斷", "觀點", "看法", "認為")),
    (
        "purpose",
        ("為什麼要", "目的", "為了", "保住", "保存", "保留", "避免"),
        ("目的", "為了", "需要", "避免", "保存", "保留", "資料", "資訊"),
    ),
)

# Phrases removed, in this order, before focus terms are split off.
STOP_PHRASES = (
    "請問", "小說中", "小說裡", "為什麼要", "為什麼會", "為什麼", "為何", "如何", "怎麼", "什麼樣的", "什麼", "哪些", "哪一項",
    "第一次", "最初", "一開始", "最後", "當前", "目前", "相關規定", "規定", "所處", "面臨", "使用", "透過", "通過", "接觸到",
    "接觸", "介紹", "研究", "展現", "特殊能力", "思考方式", "能力", "想向", "想要", "說明", "代表", "被證明是", "被證明", "的是",
    "是", "的", "了", "與", "和", "及", "或", "在", "時", "中", "裡", "內", "對", "向", "用", "有", "要", "會", "很", "能", "不",
    "嗎", "？", "?",
)
FOCUS_STOP_TERMS = (
    "問題", "原因", "背景", "主要", "小說", "遊戲", "內容", "資料", "資訊", "方式", "方法", "不同", "差異", "影響", "結果",
)
COMPOUND_SUFFIXES = (
    "相關規定", "適用範圍", "天數上限", "實驗", "模型", "行動", "材料", "文明", "規定", "天數", "上限", "下限", "期限", "流程",
    "程序", "方式", "方法", "條件", "定義", "內容",
)
PUNCTUATION = r"[，。！？!?、：:；;（）()\[\]【】\n\r\t]+"

# Questions that need no retrieval at all.
SMALL_TALK = ("你好", "嗨", "哈囉", "hello", "hi", "謝謝", "謝謝你", "thanks", "thankyou", "測試", "test")
DIRECT_PATTERNS = (
    r"(?i)^(你是誰|你可以做什麼|你能做什麼|你會做什麼|你有什麼功能)[？?。!！]*$",
    r"(?i)^(請)?(幫我)?(翻譯|改寫|潤稿|整理格式)[：:].+",
)
CLOCK_PATTERNS = (
    r"^(?:今天|今日)(?:是)?(?:(?:幾號|幾月幾日|什麼日期|日期)(?:星期幾|禮拜幾|週幾|周幾)?|(?:星期幾|禮拜幾|週幾|周幾))$",
    r"^(?:現在|目前)(?:是)?(?:幾點|幾點鐘|什麼時間|時間)$",
    r"^(?:幾點|幾點鐘)$",
)
SOURCE_PATTERNS = (
    r"(?i)(?:依|根據|按照).{0,24}(?:法律|法規|法|條例|準則|規範|政策|文件|報告|研究|論文|官方資料)",
    r"(?i)(?:法律|法規|條例|準則|規範|政策|官方資料).{0,24}(?:規定|要求|內容|定義|指出|顯示|期限|上限|下限)",
    r"(?i)(?:來源|引文|引用|citation|cite|查證|查詢|搜尋|search|官方來源)",
)
DURATION_BOUNDARY = r"(?:剛好|正好|已經)?(?:滿|超過|未滿)[一二兩三四五六七八九十百\d.]+(?:年|個月|月)"
PRECISION_PATTERN = (
    r"(?i)(?:多少|多久|何時|何年|哪年|哪一天|幾(?:天|日|年|月|小時|分鐘|秒|公里|公尺|人|項|次)|"
    + DURATION_BOUNDARY
    + r"|哪(?:一|兩|幾|\d+)項|上限|下限|期限|預告期|費率|比例|距離|時長|日期|金額|數量|版本|型號|計算|公式)"
)
DOMAIN_SUBJECT = r"[\x{4e00}-\x{9fff}]{2,}(?:號|任務|法案|條例|準則|標準|規範|政策|模型|產品|公司|機構|研究)"
GREETING = (
    r"(?i)^(?:thank you|謝謝你|你好|您好|哈囉|哈啰|thanks|hello|hey|謝謝|嗨|hi)[，,。.!！\s]*"
    r"(?:請問|想問一下|我想問|可以問一下|麻煩你|麻煩|請你|請幫我|幫我)?[，,。:：\s]*"
)
CORE_STOP_TERMS = ("公司", "規定", "相關", "哪些", "什麼", "怎麼樣", "有沒有")


def complexity(question: Column, n_variants: Column | None = None, n_sub_questions: Column | None = None, threshold: float = 2.0) -> Column:
    """``struct<score,is_complex,label>`` of a question."""
    text = clean_spaces(question)
    dense = compact(question)
    characters = F.size(find_all(text, r"[\x{4e00}-\x{9fff}A-Za-z0-9]"))
    points = (
        F.when(characters >= 80, 2.0).when(characters >= 45, 1.0).otherwise(0.0)
        + F.when(any_contains(dense, CLAUSE_MARKERS), 1.0).otherwise(0.0)
        + F.when(any_contains(dense, COMPLEX_MARKERS), 1.0).otherwise(0.0)
        + F.when(F.size(find_all(text, "[？?]")) >= 2, 1.0).otherwise(0.0)
        + F.when(F.coalesce(n_sub_questions, F.lit(0)) >= 2 if n_sub_questions is not None else F.lit(False), 2.0).otherwise(0.0)
        + F.when(F.coalesce(n_variants, F.lit(0)) >= 3 if n_variants is not None else F.lit(False), 1.0).otherwise(0.0)
        + F.when(dense.rlike(DEFINITION_PATTERN) & text.rlike(ACRONYM_PATTERN), 2.0).otherwise(0.0)
    )
    limit = max(1.0, float(threshold))
    return let(
        points,
        lambda p: F.struct(
            p.alias("score"),
            (p >= limit).alias("is_complex"),
            F.when(p >= limit, "complex").otherwise("simple").alias("label"),
        ),
    )


def _marker_count(dense: Column, markers: tuple[str, ...]) -> Column:
    return F.size(contained_terms(dense, markers))


def classify(question: Column) -> Column:
    """``hybrid`` / ``relation`` / ``content`` by marker counts."""
    dense = compact(question)
    relation, hybrid = _marker_count(dense, RELATION_MARKERS), _marker_count(dense, HYBRID_MARKERS)
    named = text_of(question).rlike(r"[A-Za-z]{2,}|[\x{4e00}-\x{9fff}]{2,}")
    return (
        F.when((hybrid > 0) & ((relation > 0) | named), "hybrid").when(relation > 0, "relation").otherwise("content")
    )


def intent_labels(question: Column) -> Column:
    dense = F.regexp_replace(text_of(question), r"(?U)\s+", "")
    hits = F.filter(
        F.array(*[F.when(any_contains(dense, markers), F.lit(label)) for label, markers, _ in INTENTS]),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("fact")))


def intent_terms(question: Column) -> Column:
    dense = F.regexp_replace(text_of(question), r"(?U)\s+", "")
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            *[
                F.when(any_contains(dense, markers), F.array(*[F.lit(t) for t in terms])).otherwise(empty)
                for _, markers, terms in INTENTS
            ]
        )
    )


def quoted_terms(text: Column) -> Column:
    return find_all(text, r"[「『《]([^」』》]{1,30})[」』》]", 1)


def split_focus(text: Column) -> Column:
    """Remove stop phrases in list order, then split on punctuation and blanks."""
    for phrase in STOP_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return F.filter(F.split(clean_spaces(F.regexp_replace(text, PUNCTUATION, " ")), " "), lambda t: t != "")


def _peel(term: Column) -> Column:
    """``struct<base,suffix>`` of a compound term, or null when none of the suffixes fits."""
    out = F.lit(None).cast("struct<base:string,suffix:string>")
    for suffix in reversed(COMPOUND_SUFFIXES):
        n = len(suffix)
        fits = (F.length(term) >= 4) & term.endswith(suffix) & (F.length(term) > n + 1)
        out = F.when(
            fits,
            F.struct(F.substring(term, F.lit(1), F.length(term) - n).alias("base"), F.lit(suffix).alias("suffix")),
        ).otherwise(out)
    return out


def compound_subterms(terms: Column) -> Column:
    """Bases and suffixes of compound terms, peeled until nothing peels; each step shortens the term."""

    def peel_all(term: Column) -> Column:
        start = F.struct(
            F.regexp_replace(term, r"(?U)\s+", "").alias("rest"), F.array().cast("array<string>").alias("found")
        )

        def step(state: Column, _i: Column) -> Column:
            return let(
                _peel(state["rest"]),
                lambda cut: F.when(
                    cut.isNotNull(),
                    F.struct(cut["base"].alias("rest"), F.concat(state["found"], F.array(cut["base"], cut["suffix"])).alias("found")),
                ).otherwise(F.struct(F.lit("").alias("rest"), state["found"].alias("found"))),
            )

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))), start, step, lambda s: s["found"])

    return F.flatten(F.transform(terms, peel_all))


def focus_terms(question: Column) -> Column:
    """Quoted terms, remaining phrases and their compound parts, 2 to 24 characters."""

    def useful(term: Column) -> Column:
        dense = F.regexp_replace(term, r"(?U)\s+", "")
        return F.length(dense).between(2, 24) & ~dense.isin(*FOCUS_STOP_TERMS)

    return let(
        clean_spaces(question),
        lambda text: let(
            F.concat(quoted_terms(text), split_focus(text)),
            lambda terms: F.array_distinct(
                F.transform(F.filter(F.concat(terms, compound_subterms(terms)), useful), clean_spaces)
            ),
        ),
    )


def _join(*arrays: Column) -> Column:
    return F.array_join(F.concat(*arrays), " ")


def retrieval_plan(
    questions: DataFrame, question: str = "question", primary: str | None = None, rewritten: str | None = None, max_variants: int = 4
) -> DataFrame:
    """Add ``variants`` (ordered, distinct) and ``evidence_query`` to questions."""
    empty = F.lit("")
    first = text_of(primary) if primary else empty
    second = text_of(rewritten) if rewritten else empty
    staged = questions.withColumn("focus", focus_terms(F.col(question))).withColumn("intent", intent_terms(F.col(question)))
    focus, intent = F.col("focus"), F.col("intent")
    near = F.transform(
        F.slice(focus, 1, 5),
        lambda _t, i: F.concat_ws(
            " ",
            F.array_join(F.slice(F.col("focus"), F.greatest(i, F.lit(1)), F.when(i == 0, F.lit(2)).otherwise(F.lit(3))), " "),
            F.array_join(F.slice(F.col("intent"), 1, 3), " "),
        ),
    )
    pairwise = F.when(
        F.size(focus) > 0, F.concat(F.array(_join(F.slice(focus, 1, 4), F.slice(intent, 1, 5))), near)
    ).otherwise(F.array().cast("array<string>"))
    options = F.concat(
        F.array(first, F.col(question), second, _join(focus, intent), _join(F.slice(focus, 1, 5), intent)), pairwise
    )
    tidy = F.array_distinct(F.filter(F.transform(options, clean_spaces), lambda v: v != ""))
    evidence = F.array_distinct(
        F.filter(
            F.transform(F.concat(F.array(F.col(question), first, second), focus, intent), clean_spaces), lambda v: v != ""
        )
    )
    return staged.withColumn("variants", F.slice(tidy, 1, max_variants)).withColumn("evidence_query", F.array_join(evidence, " "))


def planned_queries(questions: DataFrame, max_variants: int = 2) -> DataFrame:
    """One row per planned query: retrieval query, variants, question; distinct, cut to the limit.

    ``questions(query_id, question, retrieval_query, variants array<string>)``.
    """
    options = F.concat(F.array(text_of("retrieval_query")), F.coalesce("variants", F.array().cast("array<string>")), F.array(text_of("question")))
    tidy = F.slice(F.array_distinct(F.filter(F.transform(options, strip), lambda v: v != "")), 1, max_variants)
    return questions.select("query_id", F.posexplode(tidy).alias("variant", "text"))


def _alias_terms() -> tuple[Column, Column]:
    """Primary and support terms of an alias record."""
    primary = F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    support = F.array_compact(
        F.concat(F.coalesce("related_terms", F.array().cast("array<string>")), F.coalesce("triggers", F.array().cast("array<string>")))
    )
    return primary, support


def alias_matches(questions: DataFrame, aliases: DataFrame, question: str = "question") -> DataFrame:
    """Distinct ``query_id, record_no`` of the alias records that a question mentions.

    A primary term matches as a substring or by all of its tokens, a support term
    only as a substring longer than two characters. Both become equi-joins. Every
    ``query_id`` is one question.
    """
    from corpusmill.operators.matching import contains_pairs

    primary, support = _alias_terms()
    asked = questions.select("query_id", F.lower(text_of(question)).alias("_q"))
    terms = aliases.select("record_no", F.explode(F.transform(primary, lambda t: F.struct(strip(t).alias("term"), F.lit(True).alias("p")))).alias("t")).unionByName(
        aliases.select("record_no", F.explode(F.transform(support, lambda t: F.struct(strip(t).alias("term"), F.lit(False).alias("p")))).alias("t"))
    ).select("record_no", F.lower("t.term").alias("term"), F.col("t.p").alias("is_primary")).filter("term <> ''")
    terms = terms.filter(F.col("is_primary") | (F.length("term") > 2)).withColumn("term_no", F.xxhash64("record_no", "term", "is_primary"))
    by_text = contains_pairs(asked, terms, "query_id", "_q", "term_no", "term").join(terms.select("term_no", "record_no"), "term_no")
    # Token matches: every token of a primary term is among the question's tokens.
    term_tokens = terms.filter("is_primary").select("term_no", "record_no", F.array_distinct(bm25_tokens("term")).alias("toks")).filter(F.size("toks") > 0)
    wanted = term_tokens.select("term_no", "record_no", F.size("toks").alias("need"), F.explode("toks").alias("tok"))
    have = asked.select("query_id", F.explode(F.array_distinct(bm25_tokens("_q"))).alias("tok"))
    by_token = (
        have.join(wanted, "tok").groupBy("query_id", "term_no", "record_no", "need").agg(F.count("*").alias("n")).filter("n = need")
    )
    return by_text.select("query_id", "record_no").unionByName(by_token.select("query_id", "record_no")).distinct()


def expand_with_aliases(questions: DataFrame, aliases: DataFrame, question: str = "question") -> DataFrame:
    """Append the terms of every alias record a question mentions.

    ``aliases(record_no, canonical, aliases, related_terms, triggers)``, matched as
    in ``alias_matches``.
    """
    primary, support = _alias_terms()
    matched = alias_matches(questions, aliases, question)
    added = matched.join(
        aliases.select("record_no", "canonical", F.filter(F.transform(F.concat(primary, support), strip), lambda t: t != "").alias("adds")), "record_no"
    )
    # Alias dictionaries are small dimensions: few records match one question.
    per_query = added.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("record_no", "canonical", "adds"))).alias("m"))
    return questions.join(per_query, "query_id", "left").select(
        *questions.columns,
        F.coalesce(F.array_distinct(F.flatten(F.transform("m", lambda r: r["adds"]))), F.array().cast("array<string>")).alias("added_terms"),
        F.coalesce(F.array_distinct(F.transform("m", lambda r: r["canonical"])), F.array().cast("array<string>")).alias("matched_aliases"),
    ).withColumn("expanded_query", F.trim(F.concat_ws(" ", F.col(question), F.array_join("added_terms", " "))))


def trigger_matches(query: Column, triggers: Column) -> Column:
    """``array<struct<all,any>>`` triggers: all of one list and any of the other."""
    dense = F.regexp_replace(text_of(query), r"(?U)\s+", "")

    def fires(trigger: Column) -> Column:
        every = F.filter(F.coalesce(trigger["all"], F.array().cast("array<string>")), lambda t: strip(t) != "")
        some = F.filter(F.coalesce(trigger["any"], F.array().cast("array<string>")), lambda t: strip(t) != "")
        has = lambda t: F.contains(dense, F.regexp_replace(t, r"(?U)\s+", ""))
        return (
            ((F.size(every) > 0) | (F.size(some) > 0))
            & ((F.size(every) == 0) | F.forall(every, has))
            & ((F.size(some) == 0) | F.exists(some, has))
        )

    return F.exists(F.coalesce(triggers, F.array().cast("array<struct<all:array<string>,any:array<string>>>")), fires)


def concept_terms(question: Column, rules: list[tuple[list[str], list[str]]]) -> Column:
    """Profile rules ``(markers, terms)``: a question with a marker gets the terms."""
    lowered = F.lower(text_of(question))
    empty = F.array().cast("array<string>")
    if not rules:
        return empty
    return F.array_distinct(
        F.concat(
            *[
                F.when(any_contains(lowered, [m.lower() for m in markers]), F.array(*[F.lit(t) for t in terms])).otherwise(empty)
                for markers, terms in rules
            ]
        )
    )


def asks_clock(question: Column) -> Column:
    dense = F.regexp_replace(compact(question), r"[？?。.!！,，、]|請問|呢|啊", "")
    hit = F.lit(False)
    for pattern in CLOCK_PATTERNS:
        hit = hit | dense.rlike(pattern)
    return (F.length(dense) > 0) & (F.length(dense) <= 28) & hit


def is_arithmetic(question: Column) -> Column:
    dense = F.regexp_replace(compact(question), r"[？?。.!！,，]", "")
    dense = F.regexp_replace(dense, r"^(?:請問|請計算|幫我算|計算)", "")
    dense = F.regexp_replace(dense, r"(?:等於多少|是多少|答案是什麼|等於|的答案)$", "")
    dense = F.translate(dense, "×÷％", "*/%")
    return dense.rlike(r"^[\d.()+\-*/%^=]+$") & dense.rlike(r"[+\-*/%^=]")


def needs_evidence(question: Column) -> Column:
    """``source``, ``precision`` or an empty string."""
    text = clean_spaces(question)
    sourced = F.lit(False)
    for pattern in SOURCE_PATTERNS:
        sourced = sourced | text.rlike(pattern)
    specific = (
        (F.size(find_all(text, r"[\x{4e00}-\x{9fff}]")) >= 12)
        | text.rlike(r"(?U)\b[A-Z][A-Za-z0-9-]{1,}\b")
        | text.rlike(DOMAIN_SUBJECT)
        | text.rlike(DURATION_BOUNDARY)
    )
    return F.when(sourced, "source").when(text.rlike(PRECISION_PATTERN) & specific, "precision").otherwise("")


def retrieval_decision(question: Column) -> Column:
    """``retrieve``, ``direct`` or ``undecided`` (left to a model)."""
    dense = compact(question)
    direct = F.lit(False)
    for pattern in DIRECT_PATTERNS:
        direct = direct | strip(text_of(question)).rlike(pattern)
    return (
        F.when(dense == "", "direct")
        .when(asks_clock(question) | is_arithmetic(question) | dense.isin(*SMALL_TALK) | direct, "direct")
        .when(needs_evidence(question) != "", "retrieve")
        .otherwise("undecided")
    )


def strip_greeting(question: Column) -> Column:
    text = strip(text_of(question))
    return let(
        strip(F.regexp_replace(text, GREETING, "")), lambda s: F.when(s != "", s).otherwise(text)
    )


def core_terms(text: Column) -> Column:
    dense = F.regexp_replace(text_of(text), r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", "")
    return F.array_distinct(F.filter(multi_ngrams(dense, (4, 3, 2)), lambda t: ~t.isin(*CORE_STOP_TERMS)))


def sanitize_rewrite(question: Column, rewrite: Column) -> Column:
    """Keep a rewrite only if it shares a 2-4 character gram."""
    tidy = strip(clean_spaces(rewrite))
    dense = F.regexp_replace(tidy, r"(?U)\s+", "")
    shared = let(dense, lambda d: F.exists(core_terms(question), lambda t: F.contains(d, t)))
    return F.when((tidy != "") & shared, tidy).otherwise(text_of(question))


def semantic_gate(
    rewrites: DataFrame,
    question: str = "question",
    rewrite: str = "rewrite",
    min_similarity: float = 0.60,
    factory: Callable[[], Embedder] = hashing_embedder,
) -> DataFrame:
    """Cosine of question and rewrite; below the threshold a rewrite is not kept."""
    scored = rewrites.withColumn("_a", embed(F.col(question), factory)).withColumn("_b", embed(F.col(rewrite), factory))
    same = clean_spaces(F.col(question)) == clean_spaces(F.col(rewrite))
    return (
        scored.withColumn("similarity", F.when(same, F.lit(1.0)).otherwise(cosine(F.col("_a"), F.col("_b"))))
        .withColumn("kept", F.round("similarity", 9) >= min_similarity)
        .drop("_a", "_b")
    )


def sequence_labels(text: Column) -> Column:
    """Explicit round / chapter labels asked for, normalized."""
    raw = text_of(text)
    cjk = F.transform(find_all(raw, r"第\s*\d+\s*(?:輪|章|節|段|步|天|次|回合|階段)"), lambda t: F.regexp_replace(t, r"\s+", ""))
    words = "(?:round|chapter|section|step|phase|day)"
    after = F.transform(
        find_all(raw, rf"(?iU)\b{words}\s*\d+\b"), lambda t: F.regexp_replace(F.lower(t), r"^([a-z]+)\s*(\d+)$", "$1 $2")
    )
    before = F.transform(
        find_all(raw, rf"(?iU)\b\d+\s*{words}\b"), lambda t: F.regexp_replace(F.lower(t), r"^(\d+)\s*([a-z]+)$", "$2 $1")
    )
    return F.array_distinct(F.concat(cjk, after, before))


def sequence_number(text: Column) -> Column:
    lowered = F.lower(text_of(text))
    words = "(?:round|chapter|section|step|phase|day)"
    picks = [
        F.regexp_extract(lowered, r"第\s*(\d+)\s*(?:輪|章|節|段|步|天|次|回合|階段)", 1),
        F.regexp_extract(lowered, rf"(?U)\b{words}\s*(\d+)\b", 1),
        F.regexp_extract(lowered, rf"(?U)\b(\d+)\s*{words}\b", 1),
    ]
    return F.coalesce(*[p.try_cast("bigint") for p in picks], F.lit(1_000_000_000).cast("bigint"))


def metadata_filter(questions: DataFrame, chunks: DataFrame, fields: tuple[str, ...], question: str = "question") -> DataFrame:
    """Allowed ``(query_id, chunk_id)``: metadata values named in the question.

    AND over fields, OR within a field; a question naming nothing, or nothing that
    exists together, is not restricted and yields no row here.
    """
    from corpusmill.operators.matching import contains_pairs

    asked = questions.select("query_id", compact(F.col(question)).alias("_q"))
    values = None
    for field in fields:
        part = chunks.select(F.lit(field).alias("field"), strip(text_of(field)).alias("value")).filter("value <> ''").distinct()
        values = part if values is None else values.unionByName(part)
    values = values.withColumn("_v", compact(F.col("value"))).withColumn("value_no", F.xxhash64("field", "value"))
    named = contains_pairs(asked, values, "query_id", "_q", "value_no", "_v").join(values.select("value_no", "field", "value"), "value_no")
    need = named.groupBy("query_id").agg(F.countDistinct("field").alias("need"))
    # Long form of the metadata: one row per chunk and filled field.
    tagged = None
    for field in fields:
        part = chunks.select("chunk_id", F.lit(field).alias("field"), strip(text_of(field)).alias("value")).filter("value <> ''")
        tagged = part if tagged is None else tagged.unionByName(part)
    hits = named.select("query_id", "field", "value").join(tagged, ["field", "value"])
    counted = hits.groupBy("query_id", "chunk_id").agg(F.countDistinct("field").alias("n")).join(need, "query_id")
    return counted.filter("n = need").select("query_id", "chunk_id")


def fallback_keywords(question: Column, limit: int = 12) -> Column:
    words = find_all(question, r"[A-Za-z0-9_.-]+|[\x{4e00}-\x{9fff}]{2,}")
    return F.slice(F.array_distinct(F.filter(words, lambda t: F.length(t) >= 2)), 1, limit)


def keyword_variants(question: Column, refined: Column, keywords: Column) -> Column:
    """The four weighted variants searched together."""
    joined = F.array_join(keywords, " ")
    rows = [
        ("original", question, 1.0),
        ("refined", refined, 1.1),
        ("keywords", joined, 1.0),
        ("combined", F.concat_ws(" ", question, refined, joined), 0.85),
    ]
    return F.filter(
        F.array(*[F.struct(F.lit(n).alias("name"), clean_spaces(q).alias("query"), F.lit(w).alias("weight")) for n, q, w in rows]),
        lambda v: v["query"] != "",
    )


# Labels of the lines of a rewriting model's reply.
PRIMARY_LABEL = "向量檢索用查詢："
QUERY_LINE = r"(?U)^\s*(?:檢索查詢|搜尋查詢)\s*\d*\s*[：:]\s*(.+?)\s*$"
SUB_QUESTION_LINE = r"(?U)^\s*子問題\s*\d*\s*[：:]\s*(.+?)\s*$"
LABEL_EDGES = " -•\t"
KEYWORD_EDGES = " \t\r\n,，。！？!?、;；"


def _labelled(reply: Column, pattern: str) -> Column:
    """Contents of the lines of ``reply`` that match ``pattern``, in order."""
    found = F.transform(F.filter(F.split(text_of(reply), r"\R", -1), lambda s: s.rlike(pattern)), lambda s: F.btrim(F.regexp_extract(s, pattern, 1), F.lit(LABEL_EDGES)))
    return F.filter(found, lambda s: s != "")


def primary_query(reply: Column) -> Column:
    """What follows the label of the main query, else the last line of a reply."""
    lines = F.split(strip(text_of(reply)), r"\R", -1)
    named = F.filter(lines, lambda s: F.contains(s, F.lit(PRIMARY_LABEL)))
    return F.when(F.size(named) > 0, strip(F.regexp_replace(F.get(named, F.lit(0)), f"^.*?{PRIMARY_LABEL}", ""))).otherwise(strip(F.element_at(lines, -1)))


def retrieval_queries(reply: Column, limit: int = 6) -> Column:
    """Distinct queries of a rewriting model's reply, the main one first."""
    every = F.filter(F.concat(F.array(primary_query(reply)), _labelled(reply, QUERY_LINE)), lambda s: s != "")
    return F.slice(F.array_distinct(every), 1, limit)


def sub_questions(reply: Column, limit: int = 4) -> Column:
    """Distinct sub-questions that a reply lists."""
    return F.slice(F.array_distinct(_labelled(reply, SUB_QUESTION_LINE)), 1, limit)


def parsed_keywords(reply: Column) -> Column:
    """Distinct keywords of a reply: a JSON list, or the ``keywords`` of a JSON object that may stand in other text."""
    text = strip(text_of(reply))
    held = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    words = F.coalesce(listed, F.from_json(F.get_json_object(F.nullif(held, F.lit("")), "$.keywords"), "array<string>"), F.array().cast("array<string>"))
    tidy = F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.btrim(F.regexp_replace(w, r"(?U)\s+", " "), F.lit(KEYWORD_EDGES)))
    return F.array_distinct(F.filter(tidy, lambda w: w != ""))
