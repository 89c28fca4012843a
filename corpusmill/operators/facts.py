"""Facts read once from evidence lines and probed by questions.

A fact is a numbered thing ("12號訂單", "customer 12") or a ``key: value`` line, with
the scope it holds in (the evidence of a question, or a document that many questions
ask), and its place. Questions meet facts by scope, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import any_contains, let, strip, text_of
from corpusmill.operators.evidence import split_key_value

# What asks for existence or success, what confirms it, and words
# that are no kind of thing.
EXISTENCE = ("有", "存在", "參與", "出現", "是否", "嗎", "沒有")
NO_TYPES = ("第", "輪", "章", "節", "步", "天", "次", "回合", "階段", "part")
TYPE_END = "參與|存在|出現|嗎|呢|是否|有沒有"
ENGLISH_TYPES = "player|customer|client|device|account|user"
SUCCESS_ASKED = ("是否成功", "有沒有成功", "能不能確認", "能否確認", "成功嗎")
SUCCESS_PATTERNS = (
    r"([\x{4e00}-\x{9fff}A-Za-z_]{1,12})是否成功",
    r"([\x{4e00}-\x{9fff}A-Za-z_]{1,12})有沒有成功",
    r"確認([\x{4e00}-\x{9fff}A-Za-z_]{1,12})是否成功",
    r"([\x{4e00}-\x{9fff}A-Za-z_]{1,12})成功嗎",
)
ACTION_NOISE = ("資料中能不能", "資料中能否", "能不能", "能否", "是否", "有沒有", "確認", "最後", "結果")
SUCCESS = ("成功", "已完成", "完成", "命中", "核准", "通過")
NAME = r"[\x{4e00}-\x{9fff}A-Za-z_]+"


def bare_line(line: Column) -> Column:
    """A line without its bullet and source label."""
    plain = F.regexp_replace(strip(line), r"^- (?U)\s*", "")
    return let(plain, lambda s: F.when(F.contains(s, F.lit("] ")), strip(F.regexp_replace(s, r"(?s)^.*?\] ", ""))).otherwise(strip(s)))


def asked_entity(question: Column) -> Column:
    """``struct<entity_type,number>`` of a question about a numbered thing, else null."""
    text = text_of(question)
    han = rf"(\d+)\s*號\s*({NAME})"
    latin = rf"(?i)\b({ENGLISH_TYPES})\s*(\d+)\b"
    named = strip(F.regexp_replace(F.regexp_extract(text, han, 2), f"(?s)({TYPE_END}).*$", ""))
    by_han = F.when((named != "") & ~named.isin(*NO_TYPES), F.struct(named.alias("entity_type"), F.regexp_extract(text, han, 1).cast("decimal(38,0)").alias("number")))
    by_latin = F.when(
        F.regexp_extract(text, latin, 1) != "", F.struct(F.lower(F.regexp_extract(text, latin, 1)).alias("entity_type"), F.regexp_extract(text, latin, 2).cast("decimal(38,0)").alias("number"))
    )
    return F.when(any_contains(text, EXISTENCE), F.when(text.rlike(han), by_han).otherwise(by_latin))


def entity_facts(lines: DataFrame, line: str = "line") -> DataFrame:
    """``scope, place, before, after, number`` of every number beside a name in ``lines(scope, place, line)``.

    ``before`` is the name in front of the number, ``after`` the one behind "號";
    both null: a number that counts for every kind.
    """
    inner = F.when(F.col("content").rlike(r"(?s)^[【\[].+[】\]]$"), F.expr("substring(content, 2, length(content) - 2)")).otherwise(F.col("content"))
    rows = lines.select("scope", "place", bare_line(F.col(line)).alias("content")).select("scope", "place", inner.alias("content"))

    def listed(pattern: str, name: int | None, number: int) -> Column:
        values = F.regexp_extract_all("content", F.lit(pattern), F.lit(number))
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(name)) if name else F.transform(values, lambda v: F.lit(None).cast("string"))
        return F.arrays_zip(names.alias("name"), values.alias("number"))

    kinds = [("any", r"(?i)API\s*AI\s*(\d+)", None, 1), ("after", rf"(\d+)\s*號\s*({NAME})", 2, 1), ("before", rf"({NAME})\s*(\d+)", 1, 2)]

    def tagged(kind: str, pairs: Column) -> Column:
        return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x["name"]).alias("name"), x["number"].cast("decimal(38,0)").alias("number")))

    parts = [tagged(kind, listed(pattern, name, number)) for kind, pattern, name, number in kinds]
    facts = rows.select("scope", "place", F.explode(F.concat(*parts)).alias("f")).select("scope", "place", "f.*")
    side = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    return facts.select("scope", "place", side("before").alias("before"), side("after").alias("after"), "number")


def entity_existence(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether the numbered thing of each question is among the facts of its scope.

    ``questions(query_id, scope, question)``; ``query_id, entity_type, number, verdict
    (yes, no, unknown), numbers, answer``. Questions about something else are left out.
    """
    asked = questions.select("query_id", "scope", asked_entity(F.col("question")).alias("e")).where("e IS NOT NULL").select("query_id", "scope", "e.*")
    kind = F.lower("entity_type")
    fits = (F.col("before").isNull() & F.col("after").isNull()) | F.coalesce(F.endswith("before", kind), F.lit(False)) | F.coalesce(F.startswith("after", kind), F.lit(False))
    seen = asked.join(facts.select("scope", "before", "after", F.col("number").alias("seen")), "scope").where(fits)
    # Distinct before they meet, so that copies of a line never gather.
    numbers = seen.select("query_id", "seen").distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("seen")).alias("numbers"))
    joined = asked.join(numbers, "query_id", "left")
    there = F.array_contains("numbers", F.col("number"))
    verdict = F.when(F.col("numbers").isNull(), "unknown").when(there, "yes").otherwise("no")
    label = F.concat(F.col("number").cast("string"), F.lit("號"), F.col("entity_type"))
    listed = F.array_join(F.transform("numbers", lambda n: n.cast("string")), "、")
    answer = F.when(verdict == "yes", F.concat(F.lit("可以確認有"), label, F.lit("參與。來源中的"), F.col("entity_type"), F.lit("編號包含："), listed, F.lit("。"))).when(
        verdict == "no", F.concat(F.lit("無法從來源確認有"), label, F.lit("參與。目前來源中的"), F.col("entity_type"), F.lit("編號只有："), listed, F.lit("。"))
    )
    return joined.select("query_id", "entity_type", "number", verdict.alias("verdict"), "numbers", answer.alias("answer"))


def asked_action(question: Column) -> Column:
    """The action whose success a question asks about, empty if none."""
    text = text_of(question)
    raw = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in SUCCESS_PATTERNS], F.lit(""))
    for noise in ACTION_NOISE:
        raw = F.replace(raw, F.lit(noise), F.lit(""))
    return F.when(any_contains(text, SUCCESS_ASKED), strip(raw)).otherwise("")


def action_results(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """First ``key: value`` line of the scope that names the action, and whether it confirms success.

    ``query_id, action, verdict (yes, no, unknown), line, answer``.
    """
    asked = questions.select("query_id", "scope", asked_action(F.col("question")).alias("action")).where("action <> ''")
    pairs = lines.select("scope", "place", strip(F.col("line")).alias("line"), split_key_value(F.col("line")).alias("kv")).where("kv.key <> ''")
    both = F.concat_ws(" ", "kv.key", "kv.value")
    named = asked.join(pairs, "scope").where(F.contains("kv.key", F.col("action")) | F.contains("kv.value", F.col("action")))
    first = named.groupBy("query_id").agg(F.min_by(F.struct("line", any_contains(both, SUCCESS).alias("done")), "place").alias("f"))
    joined = asked.join(first, "query_id", "left").select("query_id", "action", "f.line", "f.done")
    said = F.concat(F.lit("來源可確認"), bare_line(F.col("line")), F.lit("。"))
    verdict = F.when(F.col("line").isNull(), "unknown").when(F.col("done"), "yes").otherwise("no")
    answer = F.when(verdict == "yes", said).when(verdict == "no", F.concat(said, F.lit("但無法從來源確認"), F.col("action"), F.lit("是否成功。")))
    return joined.select("query_id", "action", verdict.alias("verdict"), "line", answer.alias("answer"))
