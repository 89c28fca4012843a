import re

from pyspark.sql import functions as F

from corpusmill.config import Settings
from corpusmill.operators import evidence as E
from corpusmill.operators import planning as P
from corpusmill.operators import quality as Q
from corpusmill.plans import ask


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "q string").select(column).collect()]


def test_complexity(spark):
    got = values(spark, ["特休幾天", "比較甲制與乙制的差異，並且說明原因", "FMLA 是什麼"], P.complexity(F.col("q"))["label"])
    assert got == ["simple", "complex", "complex"]


def test_classification(spark):
    got = values(spark, ["張三屬於哪一派", "為什麼張三建立組織", "甲是什麼"], P.classify(F.col("q")))
    assert got == ["relation", "hybrid", "content"]


def test_retrieval_decision(spark):
    got = values(spark, ["你好", "3+4*2等於多少", "今天幾號", "依勞動法規規定加班上限", "天空的顏色"], P.retrieval_decision(F.col("q")))
    assert got == ["direct", "direct", "direct", "retrieve", "undecided"]


def test_focus_terms_split_and_peel(spark):
    got = values(spark, ["請問「特休」的申請流程是什麼"], P.focus_terms(F.col("q")))[0]
    assert "特休" in got and "申請流程" in got and "申請" in got and "流程" in got


def test_greeting_and_sanitizing(spark):
    assert values(spark, ["你好，請問特休幾天", "嗨"], P.strip_greeting(F.col("q"))) == ["特休幾天", "嗨"]
    assert values(spark, ["特休天數"], P.sanitize_rewrite(F.col("q"), F.lit("特休 天數 規定"))) == ["特休 天數 規定"]
    assert values(spark, ["特休天數"], P.sanitize_rewrite(F.col("q"), F.lit("完全無關"))) == ["特休天數"]


def test_retrieval_plan_variants(spark):
    df = spark.createDataFrame([("甲模型為什麼失敗",)], "question string")
    row = P.retrieval_plan(df).first()
    assert row["variants"][0] == "甲模型為什麼失敗" and len(row["variants"]) <= 4 and len(set(row["variants"])) == len(row["variants"])


def test_planned_queries_are_ordered_and_distinct(spark):
    df = spark.createDataFrame([(1, "q", "r", ["v", "r", " "])], "query_id int, question string, retrieval_query string, variants array<string>")
    rows = P.planned_queries(df, 3).orderBy("variant").collect()
    assert [r["text"] for r in rows] == ["r", "v", "q"]


def test_alias_expansion(spark):
    aliases = spark.createDataFrame(
        [(1, "Annual Leave", ["特休"], ["vacation"], []), (2, "Sick Leave", [], [], ["flu"]), (3, "Zeta", [], ["ab"], [])],
        "record_no int, canonical string, aliases array<string>, related_terms array<string>, triggers array<string>",
    )
    asked = spark.createDataFrame([(1, "leave that is annual"), (2, "caught the flu"), (3, "about ab")], "query_id int, question string")
    rows = {r["query_id"]: r for r in P.expand_with_aliases(asked, aliases).collect()}
    assert rows[1]["matched_aliases"] == ["Annual Leave"] and rows[1]["added_terms"] == ["Annual Leave", "特休", "vacation"]
    assert rows[2]["matched_aliases"] == ["Sick Leave"] and rows[3]["added_terms"] == [] and rows[3]["expanded_query"] == "about ab"


def test_triggers(spark):
    df = spark.createDataFrame([("甲 和 乙",), ("甲",)], "q string")
    triggers = F.array(F.struct(F.array(F.lit("甲")).alias("all"), F.array(F.lit("乙"), F.lit("丙")).alias("any")))
    assert [r[0] for r in df.select(P.trigger_matches(F.col("q"), triggers)).collect()] == [True, False]


def test_sequences(spark):
    assert values(spark, ["第 3 章 and Round 2, 4 step"], P.sequence_labels(F.col("q")))[0] == ["第3章", "round 2", "step 4"]
    assert values(spark, ["第12輪", "chapter 7", "none"], P.sequence_number(F.col("q"))) == [12, 7, 10**9]


def test_metadata_filter(spark):
    chunks = spark.createDataFrame([(1, "Book A", "Ann"), (2, "Book A", "Bob"), (3, "Book B", "Ann")], "chunk_id int, book string, author string")
    asked = spark.createDataFrame([(1, "what does Ann say in Book A"), (2, "no names")], "query_id int, question string")
    rows = P.metadata_filter(asked, chunks, ("book", "author")).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in rows] == [(1, 1)]


def gate(spark, rows, question=None, mode="strict"):
    df = spark.createDataFrame(rows, "query_id int, rank int, bm25_score double, embedding_score double, matched_terms array<string>, content string")
    asked = spark.createDataFrame([(1, question)], "query_id int, question string") if question else None
    return E.evidence_gate(df, asked, mode).first()


def test_gate_levels(spark):
    assert gate(spark, [(1, 1, 3.0, 0.1, ["特休", "天數"], "")])["gate_case"] == "clear"
    assert gate(spark, [(1, 1, 3.0, 0.1, ["特休"], "")])["gate_case"] == "partial"
    assert gate(spark, [(1, 1, 0.0, 0.4, [], "")])["status"] == "ambiguous"
    assert gate(spark, [(1, 1, 3.0, 0.1, ["資料"], "")])["status"] == "irrelevant"
    weak_first = [(1, 1, 0.1, 0.0, [], ""), (1, 2, 0.9, 0.0, ["特休", "年資"], "")]
    assert gate(spark, weak_first)["sufficient"] is False and gate(spark, weak_first, mode="relaxed")["gate_case"] == "relaxed"


def test_gate_wants_a_value_near_the_subject(spark):
    terms = ["特休", "天數"]
    assert gate(spark, [(1, 1, 3.0, 0.1, terms, "特休依規定辦理")], "特休天數是幾天")["gate_case"] == "no_value"
    assert gate(spark, [(1, 1, 3.0, 0.1, terms, "特休為七日")], "特休天數是幾天")["gate_case"] == "clear"


def test_question_without_contexts_is_irrelevant(spark):
    df = spark.createDataFrame([], "query_id int, rank int, bm25_score double, embedding_score double, matched_terms array<string>, content string")
    asked = spark.createDataFrame([(1, "甲乙丙")], "query_id int, question string")
    row = E.evidence_gate(df, asked).first()
    assert (row["status"], row["sufficient"]) == ("irrelevant", False)


def test_threshold_bounds(spark):
    lines = "半年以上 1年未滿：3 日。\n1年以上 2年未滿：7 日\n2年以上：10 日"
    contexts = [(q, 1, "特休天數", lines) for q in (1, 2, 3, 4)]
    asked = [(1, "滿1年特休幾天"), (2, "滿11個月特休幾天"), (3, "滿三年特休幾天"), (4, "滿1年的計算公式")]
    got = E.resolve_threshold(
        spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame(contexts, "query_id int, rank int, title string, content string")
    )
    assert {r["query_id"]: r["result_text"] for r in got.collect()} == {1: "7 日", 2: "3 日", 3: "10 日"}


def test_threshold_follow_up_uses_the_previous_question(spark):
    asked = spark.createDataFrame([(1, "那滿2年呢", "特休幾天"), (2, "那滿2年呢", "天氣")], "query_id int, question string, previous_question string")
    contexts = spark.createDataFrame([(q, 1, "特休天數", "2年以上：10 日") for q in (1, 2)], "query_id int, rank int, title string, content string")
    assert [r["query_id"] for r in E.resolve_threshold(asked, contexts).collect()] == [1]


def test_fine_units_carry_the_article(spark):
    text = "第 3 條 勞工應遵守下列各項規定內容。超過時間者依照規定辦理補休。第4條 另有其他規定事項從其規定。"
    rows = E.fine_units(spark.createDataFrame([(1, 1, text)], "query_id int, rank int, content string")).orderBy("unit_index").collect()
    assert [r["article_key"] for r in rows] == ["第3條", "第3條", "第4條"]


def test_fine_windows_by_fraction(spark):
    df = spark.createDataFrame([(1, 1, "字" * 300)], "query_id int, rank int, content string")
    rows = E.fine_units(df, fraction=1 / 3).orderBy("unit_index").collect()
    assert [len(r["content"]) for r in rows][:2] == [100, 100]


def test_islands_merge_neighbours(spark):
    units = spark.createDataFrame(
        [(1, 1, 0, 0, "", 0, "aa", 0.5), (1, 1, 1, 0, "", 1, "bb", 0.9), (1, 1, 4, 0, "", 4, "cc", 0.7)],
        "query_id int, rank int, sentence_index int, window_index int, article_key string, unit_index int, content string, fine_score double",
    ).withColumn("lexical", F.lit(0.0)).withColumn("dense", F.lit(0.0))
    rows = E.fine_islands(units).orderBy("rank").collect()
    assert [(r["content"], r["unit_count"]) for r in rows] == [("aa bb", 2), ("cc", 1)]


def test_key_values_and_policy(spark):
    df = spark.createDataFrame([("- [來源 1] 結果：失敗",), ("no key here",)], "l string").select(E.split_key_value(F.col("l")).alias("kv"))
    assert [tuple(r["kv"]) for r in df.collect()] == [("結果", "失敗"), ("", "")]
    rows = spark.createDataFrame([("投票：贊成",), ("結果：成功",), ("備註：無",)], "l string")
    policy = E.evidence_policy(F.lit("只看任務結果，誰成功"))
    kept = rows.filter(E.include_line(E.split_key_value(F.col("l")), policy)).collect()
    assert [r["l"] for r in kept] == ["結果：成功", "備註：無"]


def test_query_sentences_clip_around_the_hit(spark):
    df = spark.createDataFrame([("a" * 300 + "特休天數" + "b" * 300 + "。短句",)], "t string")
    got = df.select(E.query_sentences(F.col("t"), F.array(F.lit("特休天數")))).first()[0]
    assert len(got) == 1 and got[0].startswith("...") and got[0].endswith("...") and "特休天數" in got[0] and len(got[0]) == 226


ANSWERS = [
    (1, "特休為七日 [1]。\n另有三十日 [2]。"),
    (2, "沒有標記的回答內容"),
    (3, "根據目前檢索資料無法確認。"),
    (4, "特休為七日 [9]"),
]


def frames(spark):
    answers = spark.createDataFrame(ANSWERS, "run_id int, answer string")
    contexts = spark.createDataFrame([(i, r, "", c) for i in (1, 2, 3, 4) for r, c in ((1, "勞工特休為七日"), (2, "其他假別"))], "run_id int, rank int, title string, content string")
    return answers, contexts


def test_citation_validation(spark):
    answers, contexts = frames(spark)
    rows = {r["run_id"]: r for r in Q.validate_citations(answers, contexts).collect()}
    assert [rows[i]["status"] for i in (1, 2, 3, 4)] == ["passed", "failed", "refused", "failed"]
    assert rows[1]["valid_citations"] == [1, 2] and rows[4]["invalid_citations"] == [9] and rows[2]["uncited_claims"] == ["沒有標記的回答內容"]
    assert Q.citations(answers, contexts).filter("run_id = 1").count() == 2


def test_answer_quality_finds_unsupported_numbers(spark):
    answers, contexts = frames(spark)
    rows = {r["run_id"]: r for r in Q.answer_quality(answers, contexts).collect()}
    assert rows[1]["unsupported_numbers"] == 1 and rows[1]["hallucination"] is True
    assert rows[3]["hallucination"] is False and rows[3]["evidence_passed"] is False


def test_gold_answers(spark):
    pairs = [("Yes, it is", "yes"), ("不是，因為", "no"), ("The Answer is Red Apple.", "red apple"), ("cannot determine that", "Insufficient information."), ("blue", "red")]
    df = spark.createDataFrame(pairs, "a string, g string")
    assert [r[0] for r in df.select(Q.matches_gold(F.col("a"), F.col("g"))).collect()] == [True, True, True, True, False]


def test_group_scores_and_caps(spark):
    df = spark.createDataFrame([("給薪七日",)], "a string")
    groups = F.array(F.array(F.lit("七日"), F.lit("7日")), F.array(F.lit("婚假")))
    assert df.select(Q.groups_score(F.col("a"), groups, F.array(F.lit("無薪")))).first()[0] == 50.0
    assert df.select(Q.groups_score(F.col("a"), groups, F.array(F.lit("給薪")))).first()[0] == 0.0
    assert df.select(Q.judge_score(F.lit(90), F.lit(True), F.lit(False), F.lit(False))).first()[0] == 49.0


def test_strict_gate(spark):
    answers = spark.createDataFrame([(1, "甲是乙 [1]。丙是丁 [2]。"), (2, "甲是乙。 丙 [1]。")], "run_id int, answer string")
    _, contexts = frames(spark)
    rows = {r["run_id"]: r["passed"] for r in Q.strict_citation_gate(answers, contexts).collect()}
    assert rows == {1: True, 2: False}


def test_settings_clamps():
    s = Settings(keyword_weight=0, embedding_weight=0, hybrid_top_k=8, multi_query_max_variants=99, chunk_strategy="odd").normalized()
    assert (s.keyword_weight, s.hybrid_top_k, s.multi_query_max_variants, s.chunk_strategy) == (0.5, 5, 8, "dynamic")
    assert Settings.from_env({"CORPUSMILL_HYBRID_BM25_B": "7", "CORPUSMILL_TOP_K": "x"}).hybrid_bm25_b == 1.0


def test_retry_rule_and_reflections(spark):
    df = spark.createDataFrame([("1: relevant supported\n2: irrelevant unsupported", 3)], "o string, n int")
    got = df.select(ask.reflections(F.col("o"), F.col("n"))).first()[0]
    assert [(r["relevant"], r["supported"]) for r in got] == [(True, True), (False, False), (False, False)]
    again = ask.should_retry(1, 2, F.lit(1), F.lit(True), F.lit(False), F.lit(2), F.lit(False))
    assert df.select(again).first()[0] is True


def test_fine_evidence_moves_contexts_once(spark):
    """Texts lie by question from the start; no second exchange deals them by question and rank."""
    rows = [(q, r, f"Alpha {q} beta gamma. Delta {r} epsilon zeta eta.") for q in range(3) for r in (1, 2)]
    contexts = spark.createDataFrame(rows, "query_id long, rank int, content string")
    asked = spark.createDataFrame([(q, "alpha beta epsilon") for q in range(3)], "query_id long, question string")
    out = E.fine_islands(E.select_fine_units(E.fine_scores(E.fine_units(contexts), asked)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, rank", plan)
    assert {r["query_id"] for r in out.collect()} == {0, 1, 2}
