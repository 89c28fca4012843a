"""Facts of the order book asked about; texts are built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import facts, verify
from corpusmill.plans.registry import query
from corpusmill.session import read_table


def order_lines(spark, sf_dir):
    """A line per order in the scope of its customer, in three wordings."""
    orders = read_table(spark, sf_dir, "orders")
    number = F.col("o_orderkey").cast("string")
    done = F.when(F.col("o_orderstatus") == "F", "已完成").when(F.col("o_orderstatus") == "P", "處理中").otherwise("未知")
    line = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("- [帳冊] "), number, F.lit("號訂單：付款"), done))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("【訂單 "), number, F.lit("】")))
        .otherwise(F.concat(F.lit("- [note 7] 出貨: 舊訂單"), number, F.lit(" "), done))
    )
    return orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("place"), line.alias("line"))


LINES_SQL = """l AS (SELECT o_custkey AS scope, o_orderkey AS place, CASE o_orderkey % 3 WHEN 0 THEN '- [帳冊] ' || o_orderkey || '號訂單：付款' || d WHEN 1 THEN '【訂單 ' || o_orderkey || '】' ELSE '- [note 7] 出貨: 舊訂單' || o_orderkey || ' ' || d END AS line, d
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '已完成' WHEN 'P' THEN '處理中' ELSE '未知' END AS d FROM orders))"""


@query(
    "entity_existence",
    f"""WITH {LINES_SQL},
        q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 1) ELSE c_custkey END AS number FROM customer),
        n AS (SELECT scope AS query_id, list(place ORDER BY place) AS numbers FROM l GROUP BY 1)
        SELECT query_id, '訂單' AS entity_type, CAST(number AS BIGINT) AS number, CASE WHEN numbers IS NULL THEN 'unknown' WHEN list_contains(numbers, number) THEN 'yes' ELSE 'no' END AS verdict,
          CASE WHEN numbers IS NULL THEN NULL WHEN list_contains(numbers, number) THEN '可以確認有' || number || '號訂單參與。來源中的訂單編號包含：' || array_to_string(numbers, '、') || '。'
            ELSE '無法從來源確認有' || number || '號訂單參與。目前來源中的訂單編號只有：' || array_to_string(numbers, '、') || '。' END AS answer
        FROM q LEFT JOIN n USING (query_id)""",
)
def entity_existence(spark, sf_dir):
    """Every customer is asked about an order: an own one, or one of that number."""
    own = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"))
    asked = read_table(spark, sf_dir, "customer").join(own, "c_custkey", "left")
    number = F.when(F.col("c_custkey") % 2 == 0, F.coalesce("first", F.lit(1))).otherwise(F.col("c_custkey")).cast("string")
    questions = asked.select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("scope"), F.concat(F.lit("請問有沒有 "), number, F.lit(" 號訂單參與結算？")).alias("question"))
    out = facts.entity_existence(questions, facts.entity_facts(order_lines(spark, sf_dir)))
    return out.select("query_id", "entity_type", F.col("number").cast("long").alias("number"), "verdict", "answer")


@query(
    "action_results",
    f"""WITH {LINES_SQL},
        q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN '付款' WHEN 1 THEN '出貨' ELSE '退貨' END AS action FROM customer),
        k AS (SELECT query_id, action, place, line, d, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM q JOIN l ON scope = query_id
              WHERE (action = '付款' AND place % 3 = 0) OR (action = '出貨' AND place % 3 = 2)),
        f AS (SELECT * FROM k WHERE n = 1),
        b AS (SELECT query_id, q.action, line, regexp_replace(line, '^- \\[[^\\]]*\\] ', '') AS said, d FROM q LEFT JOIN f USING (query_id))
        SELECT query_id, action, CASE WHEN line IS NULL THEN 'unknown' WHEN d = '已完成' THEN 'yes' ELSE 'no' END AS verdict, line,
          CASE WHEN line IS NULL THEN NULL WHEN d = '已完成' THEN '來源可確認' || said || '。' ELSE '來源可確認' || said || '。但無法從來源確認' || action || '是否成功。' END AS answer
        FROM b""",
)
def action_results(spark, sf_dir):
    """Every customer is asked whether an action succeeded."""
    action = F.when(F.col("c_custkey") % 3 == 0, "付款").when(F.col("c_custkey") % 3 == 1, "出貨").otherwise("退貨")
    questions = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("scope"), F.concat(F.lit("資料中能不能確認"), action, F.lit("是否成功？")).alias("question")
    )
    return facts.action_results(questions, order_lines(spark, sf_dir))


@query(
    "verifier_cascade",
    """SELECT c_custkey AS query_id,
        CASE c_custkey % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'overlap' WHEN 2 THEN 'event' WHEN 3 THEN 'accept' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'reject' ELSE 'open' END END AS stage,
        CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN TRUE WHEN c_custkey % 5 = 4 AND c_custkey % 2 = 1 THEN NULL ELSE FALSE END AS is_answerable,
        CAST(CASE c_custkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 WHEN 3 THEN 0.75 ELSE CASE WHEN c_custkey % 2 = 0 THEN 0.1 END END AS DOUBLE) AS confidence,
        CAST(CASE WHEN c_custkey % 5 = 1 THEN least(5, n) WHEN c_custkey % 5 = 2 THEN n ELSE 0 END AS BIGINT) AS n_spans
      FROM (SELECT c_custkey, greatest(1, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)) AS n FROM customer)""",
)
def verifier_cascade(spark, sf_dir):
    """Every customer asks about their orders; the evidence at hand differs by their number."""
    customers = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    kind = key % 5
    question = F.when(kind == 2, F.lit("這件任務的狀態？")).otherwise(F.concat(F.lit("Where is order of "), F.format_string("C%09d", key), F.lit("?")))
    questions = customers.select(key.alias("query_id"), question.alias("question"))
    score = F.when(kind == 3, 0.75).when((kind == 4) & (key % 2 == 1), 0.3).otherwise(0.1)
    contexts = customers.where(kind != 0).select(
        key.alias("query_id"), F.lit(1).alias("rank"), F.col("c_name").alias("content"), score.alias("score"),
        F.when(kind == 3, 9.0).otherwise(0.0).alias("keyword_score"), F.lit(0.0).alias("embedding_score"),
    )
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("position"))
    rows = customers.join(orders, "c_custkey", "left").withColumn("position", F.coalesce("position", F.lit(0)))
    line = F.when(kind == 1, F.concat(F.lit("- [book] note for "), F.format_string("C%09d", key))).when(kind == 2, F.lit("- 狀態: 已完成")).otherwise(F.lit("plain line"))
    lines = rows.select(key.alias("query_id"), "position", line.alias("line"))
    out = verify.verify_retrieval(questions, contexts, lines, auto_accept=True)
    return out.select("query_id", "stage", "is_answerable", "confidence", F.size("evidence_spans").cast("long").alias("n_spans"))
