"""Verifier cascade: every stage, and what reaches the model."""

import json

from corpusmill.operators import verify


def test_cascade(spark):
    def judge():
        def run(prompts):
            assert all("decided" not in p for p in prompts)  # no decided question gets here
            return [json.dumps({"is_answerable": "yes" in p, "confidence": 1.4, "evidence_spans": ["s"], "reason": "r"}) if "garbled" not in p else "no json" for p in prompts]

        return run

    asked = [
        (1, "decided: nothing here"), (2, "decided alpha omega9 thing"), (3, "decided 任務結果如何"), (4, "decided q"), (5, "decided z"), (6, "yes maybe"), (7, "no maybe"),
        (8, "garbled one"), (9, "任務由誰負責 yes"), (10, None),
    ]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    scores = {4: (0.9, 9.0, 0.0), 5: (0.1, 0.0, 0.1)}
    contexts = spark.createDataFrame([(q, r, f"text {r}", *scores.get(q, (0.3, 1.0, 0.3))) for q in range(2, 11) for r in (1, 2)], "query_id long, rank int, content string, score double, keyword_score double, embedding_score double")
    lines = [(2, n, f"- omega9 line {n}") for n in range(8)] + [(2, 9, "omega9 without bullet")] + [(3, 1, "- [s] 狀態: 已完成"), (3, 2, "- 備註: x"), (9, 1, "- 狀態: 失敗"), (6, 1, "- zz"), (7, 1, None)]
    lines = spark.createDataFrame(lines, "query_id long, position int, line string")
    got = {r["query_id"]: r for r in verify.verify_retrieval(questions, contexts, lines, judge, auto_accept=True).collect()}
    assert {q: r["stage"] for q, r in got.items()} == {1: "nothing", 2: "overlap", 3: "event", 4: "accept", 5: "reject", 6: "model", 7: "model", 8: "model", 9: "model", 10: "model"}
    assert got[2]["evidence_spans"] == [f"- omega9 line {n}" for n in range(5)] and got[2]["confidence"] == 0.85
    assert got[3]["is_answerable"] and got[3]["evidence_spans"] == ["- [s] 狀態: 已完成", "- 備註: x"]
    assert got[6]["is_answerable"] and got[6]["confidence"] == 1.0 and not got[7]["is_answerable"] and got[9]["is_answerable"]
    assert not got[8]["is_answerable"] and "readable" in got[8]["reason"] and got[1]["missing_info"] == ["no retrieved chunks"]
    open_rows = verify.verify_retrieval(questions, contexts, lines).where("stage = 'open'").collect()
    assert {r["query_id"] for r in open_rows} == {4, 6, 7, 8, 9, 10} and all(r["is_answerable"] is None for r in open_rows)


def test_replies_of_a_rewriting_model(spark):
    from pyspark.sql import functions as F

    from corpusmill.operators import planning

    replies = [
        (1, "想法\n向量檢索用查詢： a b \n檢索查詢1： - c d\n搜尋查詢 2: a b\n檢索查詢：\n子問題1：x？\n子問題 2: • y\n子問題3：x？"), (2, "only\n last line "), (3, None), (4, " "),
        (5, "\n".join(f"檢索查詢{n}：q{n}" for n in range(9)) + "\n" + "\n".join(f"子問題{n}：s{n}" for n in range(9))),
    ]
    df = spark.createDataFrame(replies, "id long, reply string")
    got = {r["id"]: (r["q"], r["s"]) for r in df.select("id", planning.retrieval_queries(F.col("reply")).alias("q"), planning.sub_questions(F.col("reply")).alias("s")).collect()}
    assert got == {
        1: (["a b", "c d"], ["x？", "y"]), 2: (["last line"], []), 3: ([], []), 4: ([], []),
        5: (["子問題8：s8", "q0", "q1", "q2", "q3", "q4"], ["s0", "s1", "s2", "s3"]),
    }
    words = ['{"keywords": ["a  b", "，c。", "a b", ""]}', 'text {"keywords": ["x", 5]} more', '["p", null, "q"]', "{broken", "", None, '{"other": 1}']
    rows = spark.createDataFrame(list(enumerate(words)), "id long, reply string").select("id", planning.parsed_keywords(F.col("reply")).alias("k")).collect()
    assert {r["id"]: r["k"] for r in rows} == {0: ["a b", "c"], 1: ["x", "5"], 2: ["p", "q"], 3: [], 4: [], 5: [], 6: []}
