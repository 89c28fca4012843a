"""Retrieval metrics and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking, graph, matching, metrics, quality, sparse
from corpusmill.plans import sqltext as Q
from corpusmill.plans.chunk_queries import trim_sql
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import bm25_hits, corpus, questions
from corpusmill.session import read_table, spread

GOLD_SQL = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold_pairs(spark, sf_dir):
    """Documents that hold an item verbatim."""
    return matching.contains_pairs(corpus(spark, sf_dir), questions(spark, sf_dir).withColumnRenamed("text", "item_text"), "chunk_id", "text", "query_id", "item_text")


@query("gold_passages", f"WITH {GOLD_SQL} SELECT query_id, chunk_id FROM gold")
def gold_passages(spark, sf_dir):
    return gold_pairs(spark, sf_dir).select("query_id", "chunk_id")


RECALL_SQL = f"""WITH {Q.bm25_ctes(30)}, {GOLD_SQL},
    g AS (SELECT query_id, count(*) AS gold_count FROM gold GROUP BY 1),
    m AS (SELECT query_id, count(*) AS matched, min(rank) AS first_hit_rank FROM bm JOIN gold USING (query_id, chunk_id) GROUP BY 1),
    cs AS (SELECT b.item_id AS query_id, length(b.text) AS n_chars, coalesce(gold_count, 0) AS gold_count, CASE WHEN gold_count IS NOT NULL THEN coalesce(matched, 0) END AS matched,
      CASE WHEN gold_count IS NOT NULL THEN coalesce(matched, 0) / gold_count END AS recall, first_hit_rank FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id LEFT JOIN m ON m.query_id = b.item_id)"""


@query(
    "doc_recall_at_k",
    f"""{RECALL_SQL} SELECT query_id, gold_count, matched, round(recall, 6) AS recall, CASE WHEN gold_count > 0 THEN matched > 0 END AS any_hit FROM cs""",
)
def doc_recall_at_k(spark, sf_dir):
    """Document recall at 30 over the items with planted passages."""
    out = metrics.document_recall(bm25_hits(spark, sf_dir, 30), gold_pairs(spark, sf_dir), questions(spark, sf_dir))
    return out.select("query_id", "gold_count", "matched", F.round("recall", 6).alias("recall"), "any_hit")


@query("first_hit_rank", f"""{RECALL_SQL} SELECT query_id, first_hit_rank FROM cs WHERE first_hit_rank IS NOT NULL""")
def first_hit_rank(spark, sf_dir):
    out = metrics.first_hit_rank(bm25_hits(spark, sf_dir, 30), gold_pairs(spark, sf_dir))
    return out.select("query_id", F.col("first_hit_rank").cast("long").alias("first_hit_rank"))


@query(
    "metrics_breakdown_rollup",
    f"""{RECALL_SQL}, kc AS (SELECT *, CASE WHEN n_chars >= 250 THEN 'long' ELSE 'short' END AS kind FROM cs)
        SELECT coalesce(kind, 'all') AS scope, count(*) AS n_queries, count(*) FILTER (WHERE gold_count > 0) AS n_with_gold, round(sum(matched) / sum(gold_count), 6) AS micro_recall,
          round(avg(recall), 6) AS macro_recall, round(avg(CASE WHEN gold_count > 0 THEN CASE WHEN matched > 0 THEN 1.0 ELSE 0.0 END END), 6) AS any_hit_rate,
          round(avg(CASE WHEN gold_count > 0 THEN CASE WHEN matched = gold_count THEN 1.0 ELSE 0.0 END END), 6) AS complete_hit_rate, round(avg(first_hit_rank), 6) AS mean_first_hit_rank
        FROM kc GROUP BY ROLLUP (kind)""",
)
def metrics_breakdown_rollup(spark, sf_dir):
    """Total and per-length-class retrieval metrics in one pass."""
    hits, gold, asked = bm25_hits(spark, sf_dir, 30), gold_pairs(spark, sf_dir), questions(spark, sf_dir)
    cases = (
        metrics.document_recall(hits, gold, asked)
        .join(metrics.first_hit_rank(hits, gold), "query_id", "left")
        .join(asked.select("query_id", F.when(F.length("text") >= 250, "long").otherwise("short").alias("kind")), "query_id")
        .withColumn("has_gold", F.col("gold_count") > 0)
    )
    out = metrics.breakdown(cases, "kind")
    rates = ("micro_recall", "macro_recall", "any_hit_rate", "complete_hit_rate", "mean_first_hit_rank")
    return out.select("scope", "n_queries", "n_with_gold", *[F.round(c, 6).alias(c) for c in rates])


PASSAGE_SQL = f"""
    pd AS (SELECT doc_id AS d, {trim_sql('text')} AS t, length(text) - length(regexp_replace(text, '^\\s+', '')) AS lead FROM documents),
    px AS (SELECT d, t, lead, unnest(range(0, CASE WHEN length(t) <= 600 THEN CASE WHEN length(t) > 0 THEN 1 ELSE 0 END ELSE CAST(ceil((length(t) - 600) / 450.0) AS BIGINT) + 1 END)) AS i FROM pd),
    pc AS (SELECT d * 10000 + i + 1 AS doc_id, d, lead + i * 450 AS a, lead + least(length(t), i * 450 + 600) AS b, {trim_sql('substr(t, i * 450 + 1, 600)')} AS text, '' AS source FROM px),
    {Q.bm25_ctes(10, corpus="SELECT doc_id, source, text FROM pc WHERE text <> ''")},
    rt AS (SELECT query_id, rank, p.d AS file_id, p.a AS s, p.b AS e FROM bm JOIN pc p ON p.doc_id = bm.chunk_id),
    gs AS (SELECT b.item_id AS query_id, doc.doc_id AS file_id, strpos(doc.text, b.text) - 1 AS gs, strpos(doc.text, b.text) - 1 + length(b.text) AS ge FROM benchmark b JOIN documents doc ON contains(doc.text, b.text))"""


def passages(spark, sf_dir):
    """Overlapping 600-character passages, every 450 characters, with source offsets."""
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    cut = chunking.hard_chunks_with_spans(docs, "doc_id", "text", 600, 450)
    return cut.withColumn("chunk_id", F.col("doc_id") * 10000 + F.col("chunk_index"))


def retrieved_spans(spark, sf_dir, k=10):
    cut = passages(spark, sf_dir)
    hits = sparse.bm25_search(questions(spark, sf_dir), sparse.build_index(cut, "content"), k)
    spans = cut.select("chunk_id", F.col("doc_id").alias("file_id"), F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    return hits.select("query_id", "chunk_id", "rank").join(spans, "chunk_id").drop("chunk_id")


def gold_spans(spark, sf_dir):
    texts = corpus(spark, sf_dir).select("chunk_id", "text")
    asked = questions(spark, sf_dir).withColumnRenamed("text", "item")
    located = gold_pairs(spark, sf_dir).join(texts, "chunk_id").join(asked, "query_id")
    start = F.expr("instr(text, item) - 1")
    return located.select(
        "query_id",
        F.col("chunk_id").alias("span_no"),
        F.col("chunk_id").alias("file_id"),
        start.alias("start"),
        (start + F.length("item")).alias("end"),
    )


def span_report(df):
    return df.select(
        "query_id",
        "span_count",
        *[F.col(c).cast("long").alias(c) for c in ("gold_chars", "retrieved_chars", "relevant_chars")],
        F.round("char_recall", 6).alias("char_recall"),
        F.round("char_precision", 6).alias("char_precision"),
        "any_hit",
        "complete_hit",
        F.col("first_hit_rank").cast("long").alias("first_hit_rank"),
    )


@query(
    "span_overlap_metrics",
    f"""WITH {PASSAGE_SQL},
        pr AS (SELECT gs.query_id, gs.file_id AS span_no, rank, greatest(0, least(e, ge) - greatest(s, gs)) AS c FROM gs JOIN rt ON rt.query_id = gs.query_id AND rt.file_id = gs.file_id),
        tt AS (SELECT query_id, count(*) AS span_count, CAST(sum(ge - gs) AS BIGINT) AS gold_chars FROM gs GROUP BY 1),
        sh AS (SELECT query_id, CAST(sum(e - s) AS BIGINT) AS retrieved_chars FROM rt GROUP BY 1),
        rl AS (SELECT query_id, CAST(sum(c) AS BIGINT) AS relevant_chars, count(DISTINCT span_no) AS hit, min(rank) AS first_hit_rank FROM pr WHERE c > 0 GROUP BY 1)
        SELECT query_id, span_count, gold_chars, coalesce(retrieved_chars, 0) AS retrieved_chars, coalesce(relevant_chars, 0) AS relevant_chars, round(coalesce(relevant_chars, 0) / gold_chars, 6) AS char_recall,
          round(coalesce(relevant_chars, 0) / retrieved_chars, 6) AS char_precision, coalesce(hit, 0) > 0 AS any_hit, coalesce(hit, 0) = span_count AS complete_hit, first_hit_rank
        FROM tt LEFT JOIN sh USING (query_id) LEFT JOIN rl USING (query_id)""",
)
def span_overlap_metrics(spark, sf_dir):
    """Character recall where overlapping passages count twice."""
    return span_report(metrics.span_metrics(retrieved_spans(spark, sf_dir), gold_spans(spark, sf_dir)))


@query(
    "span_union_metrics",
    f"""WITH {PASSAGE_SQL},
        pr AS (SELECT gs.query_id, gs.file_id AS span_no, rank, greatest(s, gs) AS s, least(e, ge) AS e FROM gs JOIN rt ON rt.query_id = gs.query_id AND rt.file_id = gs.file_id WHERE least(e, ge) > greatest(s, gs)),
        po AS (SELECT *, max(e) OVER (PARTITION BY query_id, span_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pr),
        ro AS (SELECT *, max(e) OVER (PARTITION BY query_id, file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM rt),
        tt AS (SELECT query_id, count(*) AS span_count, CAST(sum(ge - gs) AS BIGINT) AS gold_chars FROM gs GROUP BY 1),
        sh AS (SELECT query_id, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS retrieved_chars FROM ro GROUP BY 1),
        rl AS (SELECT query_id, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS relevant_chars, count(DISTINCT span_no) AS hit, min(rank) AS first_hit_rank FROM po GROUP BY 1)
        SELECT query_id, span_count, gold_chars, coalesce(retrieved_chars, 0) AS retrieved_chars, coalesce(relevant_chars, 0) AS relevant_chars, round(coalesce(relevant_chars, 0) / gold_chars, 6) AS char_recall,
          round(coalesce(relevant_chars, 0) / retrieved_chars, 6) AS char_precision, coalesce(hit, 0) > 0 AS any_hit, coalesce(hit, 0) = span_count AS complete_hit, first_hit_rank
        FROM tt LEFT JOIN sh USING (query_id) LEFT JOIN rl USING (query_id)""",
)
def span_union_metrics(spark, sf_dir):
    """Character recall where every character counts once."""
    return span_report(metrics.span_metrics(retrieved_spans(spark, sf_dir), gold_spans(spark, sf_dir), union=True))


@query(
    "gold_fact_recall",
    f"""WITH {Q.bm25_ctes(5)},
        cx AS (SELECT query_id, string_agg(d.text, chr(10) ORDER BY bm.rank) AS body FROM bm JOIN documents d ON d.doc_id = chunk_id GROUP BY 1),
        fc AS (SELECT item_id AS query_id, unnest(range(1, len(string_split(text, '.')) + 1)) AS n, unnest(string_split(text, '.')) AS fact FROM benchmark),
        fh AS (SELECT f.query_id, len(list_intersect(list_distinct({Q.tokens('fact')}), list_distinct({Q.tokens('body')}))) / greatest(len(list_distinct({Q.tokens('fact')})), 1) >= 0.45
            OR contains(regexp_replace(lower(body), '[^a-z0-9㐀-鿿]+', '', 'g'), regexp_replace(lower(fact), '[^a-z0-9㐀-鿿]+', '', 'g')) AS hit
          FROM fc f LEFT JOIN cx USING (query_id) WHERE trim(fact) <> '')
        SELECT query_id, count(*) AS fact_total, count(*) FILTER (WHERE hit) AS fact_matched FROM fh GROUP BY query_id""",
)
def gold_fact_recall(spark, sf_dir):
    """Sentences of each item as facts, looked for in the top five documents."""
    texts = corpus(spark, sf_dir).select("chunk_id", F.col("text").alias("content"))
    contexts = bm25_hits(spark, sf_dir, 5).select("query_id", "chunk_id", "rank").join(texts, "chunk_id")
    facts = questions(spark, sf_dir).select("query_id", F.posexplode(F.split("text", r"\.")).alias("fact_no", "fact"))
    return metrics.fact_recall(contexts, facts)


# Answers: assistant turns citing ranks from their turn number; the context of a
# run is the message right before it.
ANSWER_SQL = """
    an AS (SELECT conv_id * 1000 + turn AS run_id, text || ' [' || (1 + turn % 3 // 2) || ']' AS answer FROM conversations WHERE role = 'assistant'),
    cx AS (SELECT conv_id * 1000 + turn + 1 AS run_id, 1 AS rank, text AS content FROM conversations)"""


def answers(spark, sf_dir):
    talk = read_table(spark, sf_dir, "conversations")
    mark = F.concat(F.lit(" ["), 1 + F.floor((F.col("turn") % 3) / 2), F.lit("]"))
    return talk.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"), F.concat("text", mark).alias("answer"))


def answer_contexts(spark, sf_dir):
    talk = read_table(spark, sf_dir, "conversations")
    return talk.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("run_id"), F.lit(1).alias("rank"), F.lit("").alias("title"), F.col("text").alias("content")
    )


@query(
    "citation_validation",
    rf"""WITH {ANSWER_SQL},
        mk AS (SELECT run_id, list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER))) AS m FROM an),
        e AS (SELECT run_id, unnest(m) AS rank FROM mk),
        v AS (SELECT e.run_id, count(*) FILTER (WHERE cx.run_id IS NOT NULL) AS ok, count(*) FILTER (WHERE cx.run_id IS NULL) AS bad FROM e LEFT JOIN cx ON cx.run_id = e.run_id AND cx.rank = e.rank AND trim(content) <> '' GROUP BY 1)
        SELECT run_id, CASE WHEN ok > 0 AND bad = 0 THEN 'passed' ELSE 'failed' END AS status, ok AS n_valid, bad AS n_invalid FROM v""",
)
def citation_validation(spark, sf_dir):
    out = quality.validate_citations(answers(spark, sf_dir), answer_contexts(spark, sf_dir))
    return out.select(
        "run_id", "status", F.size("valid_citations").cast("long").alias("n_valid"), F.size("invalid_citations").cast("long").alias("n_invalid")
    )


@query(
    "citations",
    rf"""WITH {ANSWER_SQL}, e AS (SELECT DISTINCT run_id, CAST(unnest(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS INTEGER) AS rank FROM an)
        SELECT run_id, rank, sha256(content) AS content_sha256 FROM e JOIN cx USING (run_id, rank)""",
)
def citations(spark, sf_dir):
    return quality.citations(answers(spark, sf_dir), answer_contexts(spark, sf_dir)).select("run_id", "rank", "content_sha256")


CLEAN_CLAIM = trim_sql(
    r"regexp_replace(regexp_replace(regexp_replace(raw, '^[-•*#]+', ''), '[*_`]+', '', 'g'), '\[(\d+)\]', '', 'g')"
)
CLAIM_SQL = rf"""{ANSWER_SQL},
    sg AS (SELECT run_id, unnest(range(1, len(ss) + 1)) AS i, {trim_sql('unnest(ss)')} AS raw FROM (SELECT run_id, string_split_regex(answer, '[\r\n]+') AS ss FROM an)),
    cl AS (SELECT run_id, i, {CLEAN_CLAIM} AS claim FROM sg WHERE raw <> ''),
    ck AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY i) - 1 AS claim_no, claim FROM cl WHERE length(claim) >= 3 AND NOT regexp_matches(claim, '^[|\-: ]+$')),
    sp AS (SELECT c.run_id, claim_no, len(list_intersect(list_distinct({Q.tokens('claim')}), list_distinct({Q.tokens('content')}))) / greatest(len(list_distinct({Q.tokens('claim')})), 1) AS lex,
      contains(regexp_replace(lower(content), '[\s　，。；：、！？（）()「」『』\[\],.!?]', '', 'g'), regexp_replace(lower(claim), '[\s　，。；：、！？（）()「」『』\[\],.!?]', '', 'g')) AS verb
      FROM ck c JOIN cx USING (run_id))"""


@query(
    "claim_support",
    f"""WITH {CLAIM_SQL} SELECT run_id, claim_no, round(lex, 6) AS max_lexical, verb OR lex >= 0.12 AS supported FROM sp""",
)
def claim_support(spark, sf_dir):
    """Lexical support of every answer statement by the message it answers."""
    out = quality.claim_support(answers(spark, sf_dir), answer_contexts(spark, sf_dir))
    return out.select("run_id", F.col("claim_no").cast("long").alias("claim_no"), F.round("max_lexical", 6).alias("max_lexical"), "supported")


@query("answer_quality")
def answer_quality(spark, sf_dir):
    """Support share, unsupported numbers and hallucination flag per run."""
    out = quality.answer_quality(answers(spark, sf_dir), answer_contexts(spark, sf_dir))
    return out.withColumn("evidence_score", F.round("evidence_score", 6))


@query("strict_citation_gate")
def strict_citation_gate(spark, sf_dir):
    return quality.strict_citation_gate(answers(spark, sf_dir), answer_contexts(spark, sf_dir))


@query(
    "answer_matches_gold",
    r"""WITH b AS (SELECT d.doc_id, d.source, d.text AS answer, split_part(d.text, ' ', 2) AS gold FROM documents d),
        c AS (SELECT doc_id, source, answer, regexp_replace(lower(gold), '[^a-z0-9㐀-鿿]+', '', 'g') AS g, regexp_replace(lower(answer), '[^a-z0-9㐀-鿿]+', '', 'g') AS a,
          list_filter(regexp_extract_all(lower(gold), '[a-z0-9]+'), lambda x: length(x) > 1) AS w, regexp_extract_all(lower(answer), '[a-z0-9]+') AS v, trim(gold) AS gg FROM b)
        SELECT source, count(*) AS n, count(*) FILTER (WHERE CASE WHEN lower(gg) = 'no' THEN regexp_matches(answer, '(?i)^\s*[:：]?\s*no') ELSE gg <> '' AND ((g <> '' AND contains(a, g)) OR (len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains(v, x))) = 0)) END) AS n_match FROM c GROUP BY source""",
)
def answer_matches_gold(spark, sf_dir):
    """Second word of each document as a short gold answer for the document text."""
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    rows = docs.select("source", quality.matches_gold(F.col("text"), F.split_part("text", F.lit(" "), F.lit(2))).alias("m"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("m").cast("long")).alias("n_match"))


ENTITY_SQL = f"""
    w AS (SELECT item_id, text, {Q.tokens('text')} AS w FROM benchmark),
    en AS (SELECT item_id AS entity_id, w[1] || w[2] AS dense, length(text) AS n FROM w WHERE len(w) >= 2),
    rl AS (SELECT item_id AS relation_id, item_id AS source, item_id + 1 AS target, 1.0 / (1 + length(text) % 10) AS confidence FROM benchmark),
    qd AS (SELECT conv_id * 100 + turn AS query_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS dense FROM conversations),
    me AS (SELECT query_id, entity_id FROM qd JOIN en ON contains(qd.dense, en.dense))"""


def item_graph(spark, sf_dir):
    """Items as entities named by their first two words, each related to the next item."""
    from corpusmill.functions.text import bm25_tokens

    items = questions(spark, sf_dir).withColumn("w", bm25_tokens("text"))
    entities = items.filter(F.size("w") >= 2).select(
        F.col("query_id").alias("entity_id"), F.concat_ws(" ", F.element_at("w", 1), F.element_at("w", 2)).alias("name"), F.array().cast("array<string>").alias("aliases")
    )
    relations = items.select(
        F.col("query_id").alias("relation_id"), F.col("query_id").alias("source"), (F.col("query_id") + 1).alias("target"),
        F.lit("USES").alias("type"), (1.0 / (1 + F.length("text") % 10)).alias("confidence"),
    )
    asked = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return entities, relations, asked


@query("entity_mentions", f"WITH {ENTITY_SQL} SELECT query_id, entity_id FROM me")
def entity_mentions(spark, sf_dir):
    entities, _, asked = item_graph(spark, sf_dir)
    return graph.mentions(asked, entities, "query_id", "question").select("query_id", "entity_id")


@query(
    "graph_relation_rank",
    f"""WITH {ENTITY_SQL},
        ov AS (SELECT query_id, relation_id, count(*) AS o FROM me JOIN (SELECT relation_id, unnest([source, target]) AS entity_id FROM rl) USING (entity_id) GROUP BY ALL),
        sc AS (SELECT query_id, relation_id, 2.0 * o + 0.5 * confidence AS score FROM ov JOIN rl USING (relation_id))
        SELECT query_id, relation_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, relation_id) AS rank FROM sc) WHERE rank <= 5""",
)
def graph_relation_rank(spark, sf_dir):
    """Relations touching the entities a conversation turn mentions."""
    entities, relations, asked = item_graph(spark, sf_dir)
    hits = graph.mentions(asked, entities, "query_id", "question")
    ranked = graph.rank_relations(asked, relations, hits, limit=5)
    return ranked.select("query_id", "relation_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))
