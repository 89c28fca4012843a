"""Question planning, evidence gating and evidence selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import bm25_tokens, clean_spaces, find_all
from corpusmill.operators import evidence, planning, rerank
from corpusmill.plans import sqltext as Q
from corpusmill.plans.chunk_queries import clean_sql, trim_sql
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import (
    _rerank_sql,
    bm25_hits,
    dense_hits,
    fused,
    questions,
    with_texts,
)
from corpusmill.session import read_table, spread

COMPLEXITY_SQL = f"""
    cx AS (SELECT item_id AS query_id, {clean_sql('text')} AS t, lower(regexp_replace(text, '\\s+', '', 'g')) AS c FROM benchmark),
    cp AS (SELECT query_id,
      CASE WHEN len(regexp_extract_all(t, '[一-鿿A-Za-z0-9]')) >= 80 THEN 2.0::DOUBLE WHEN len(regexp_extract_all(t, '[一-鿿A-Za-z0-9]')) >= 45 THEN 1.0 ELSE 0.0 END
      + CASE WHEN regexp_matches(c, '以及|並且|同時|分別|另外|此外|還有|且|及|與|和|或|、|,|；|;') THEN 1.0 ELSE 0.0 END
      + CASE WHEN regexp_matches(c, '比較|差異|不同|各自|為什麼|為何|原因|如果|條件|例外|流程|步驟|先|再') THEN 1.0 ELSE 0.0 END
      + CASE WHEN len(regexp_extract_all(t, '[？?]')) >= 2 THEN 1.0 ELSE 0.0 END
      + CASE WHEN regexp_matches(c, 'meaning|define|定義|全名|是什麼|什麼意思|代表什麼') AND regexp_matches(t, '\\b[A-Z][A-Z0-9-]{{2,12}}\\b') THEN 2.0 ELSE 0.0 END AS score FROM cx)"""


@query(
    "query_complexity",
    f"""WITH {COMPLEXITY_SQL} SELECT query_id, score, CASE WHEN score >= 2 THEN 'complex' ELSE 'simple' END AS label FROM cp""",
)
def query_complexity(spark, sf_dir):
    c = planning.complexity(F.col("text"))
    return questions(spark, sf_dir).withColumn("c", c).select("query_id", "c.score", "c.label")


@query(
    "query_routing",
    r"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(text, '\s+', '', 'g')) AS c, text FROM conversations)
        SELECT decision, count(*) AS n FROM (SELECT CASE WHEN c = '' OR c IN ('hello', 'hi', 'thanks', 'thankyou', 'test') THEN 'direct'
          WHEN regexp_matches(text, '(?i)citation|cite|search|來源|引文|引用|查證|查詢|搜尋') THEN 'retrieve' ELSE 'undecided' END AS decision FROM t) GROUP BY decision""",
)
def query_routing(spark, sf_dir):
    """Retrieve, answer directly or ask a model: every conversation turn."""
    turns = read_table(spark, sf_dir, "conversations").select(planning.retrieval_decision(F.col("text")).alias("decision"))
    return turns.groupBy("decision").agg(F.count("*").alias("n"))


@query(
    "query_variants",
    f"""WITH q AS (SELECT item_id AS query_id, [split_part(text, '.', 1), split_part(text, '.', 2), split_part(text, '.', 3), text] AS o FROM benchmark),
        u AS (SELECT query_id, {trim_sql('unnest(o)')} AS v, unnest(range(1, 5)) AS i FROM q),
        d AS (SELECT query_id, v, min(i) AS i FROM u WHERE v <> '' GROUP BY ALL),
        r AS (SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS variant FROM d)
        SELECT query_id, variant, v AS text FROM r WHERE variant < 3""",
)
def query_variants(spark, sf_dir):
    """Planned queries of every item: retrieval query, variants, question."""
    part = lambda n: F.split_part("text", F.lit("."), F.lit(n))
    asked = questions(spark, sf_dir).select(
        "query_id", F.col("text").alias("question"), part(1).alias("retrieval_query"), F.array(part(2), part(3)).alias("variants")
    )
    out = planning.planned_queries(asked, 3)
    return out.select("query_id", F.col("variant").cast("long").alias("variant"), "text")


WORDS_SQL = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({Q.STOP_LIST}))"


@query(
    "alias_expansion",
    f"""WITH w AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
        al AS (SELECT item_id AS record_no, w[1] || ' ' || w[2] AS canonical, w[3] AS support FROM w WHERE len(w) >= 3),
        q AS (SELECT conv_id * 100 + turn AS query_id, lower(text) AS t, {WORDS_SQL} AS w FROM conversations),
        m AS (SELECT query_id, record_no, canonical FROM q JOIN al ON contains(t, canonical) OR len(list_distinct(list_intersect(w, string_split(canonical, ' ')))) = len(list_distinct(string_split(canonical, ' '))) OR (length(support) > 2 AND contains(t, support)))
        SELECT query_id, count(DISTINCT canonical) AS n_aliases, min(record_no) AS first_record FROM m GROUP BY query_id""",
)
def alias_expansion(spark, sf_dir):
    """Alias records from the first words of each item, matched in every conversation turn."""
    words = questions(spark, sf_dir).select(F.col("query_id").alias("record_no"), bm25_tokens("text").alias("w")).filter(F.size("w") >= 3)
    aliases = words.select(
        "record_no",
        F.concat_ws(" ", F.element_at("w", 1), F.element_at("w", 2)).alias("canonical"),
        F.array().cast("array<string>").alias("aliases"),
        F.array(F.element_at("w", 3)).alias("related_terms"),
        F.array().cast("array<string>").alias("triggers"),
    )
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    # Turns may share a number: each is matched by itself. Records may share a name: only those that matched count.
    numbered = turns.select(F.struct("query_id", F.xxhash64(F.lower("question")).alias("text")).alias("query_id"), "question").dropDuplicates(["query_id"])
    matched = planning.alias_matches(numbered, aliases).select("query_id.query_id", "record_no")
    rows = matched.join(F.broadcast(aliases.select("record_no", "canonical")), "record_no")
    return rows.groupBy("query_id").agg(F.countDistinct("canonical").alias("n_aliases"), F.min("record_no").alias("first_record"))


@query(
    "rewrite_semantic_gate",
    """WITH r AS (SELECT item_id, text, split_part(text, '.', 1) AS rw FROM benchmark),
        b AS (SELECT item_id, 0 AS side, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[㐀-鿿]')) AS w FROM r UNION ALL SELECT item_id, 1, unnest(regexp_extract_all(lower(rw), '[a-z0-9]+|[㐀-鿿]')) FROM r),
        c AS (SELECT item_id, side, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS b, count(*) AS n FROM b GROUP BY ALL),
        s AS (SELECT x.item_id, sum(x.n * y.n) AS d FROM c x JOIN c y ON x.item_id = y.item_id AND x.b = y.b AND x.side = 0 AND y.side = 1 GROUP BY 1),
        n AS (SELECT item_id, sqrt(sum(n * n) FILTER (WHERE side = 0)) * sqrt(sum(n * n) FILTER (WHERE side = 1)) AS n FROM c GROUP BY 1),
        o AS (SELECT r.item_id AS query_id, CASE WHEN trim(text) = trim(rw) THEN 1 ELSE coalesce(d / n, 0) END AS sim FROM r LEFT JOIN s USING (item_id) LEFT JOIN n USING (item_id))
        SELECT query_id, round(sim, 6) AS similarity, round(sim, 9) >= 0.60 AS kept FROM o""",
)
def rewrite_semantic_gate(spark, sf_dir):
    """The first sentence of an item as its rewrite."""
    rows = questions(spark, sf_dir).select("query_id", F.col("text").alias("question"), F.split_part("text", F.lit("."), F.lit(1)).alias("rewrite"))
    out = planning.semantic_gate(rows)
    return out.select("query_id", F.round("similarity", 6).alias("similarity"), "kept")


@query("retrieval_plans")
def retrieval_plans(spark, sf_dir):
    """Focus terms, variants and evidence query of every conversation turn of a user."""
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    out = planning.retrieval_plan(turns)
    return out.select("conv_id", "turn", F.size("focus").alias("n_focus"), F.size("variants").alias("n_variants"), F.md5("evidence_query").alias("evidence_md5"))




@query(
    "coverage_boost",
    rf"""WITH {Q.bm25_ctes(20)},
        dn AS (SELECT item_id AS query_id, regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g') AS s, text AS q FROM benchmark),
        rw AS (SELECT query_id, list_filter(list_transform(regexp_extract_all(q, '[A-Za-z0-9_.-]+|[一-鿿]{{2,}}'), lambda x: lower(x)), lambda x: length(x) >= 2) AS ws, s FROM dn),
        t0 AS (SELECT query_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM rw),
        t1 AS (SELECT query_id, t, min(i) AS i FROM t0 GROUP BY ALL),
        t2 AS (SELECT * FROM (SELECT query_id, t, i, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM t1)),
        p0 AS (SELECT query_id, substr(s, n, 4) AS t, 1000 + n AS i FROM rw, unnest(range(1, greatest(length(s) - 2, 1))) x(n) UNION ALL SELECT query_id, substr(s, n, 3), 1000000 + n FROM rw, unnest(range(1, greatest(length(s) - 1, 1))) x(n)),
        al AS (SELECT query_id, t, min(i) AS i FROM (SELECT query_id, t, i FROM t2 UNION ALL SELECT query_id, t, i FROM p0) GROUP BY ALL),
        tm AS (SELECT * FROM (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM al)),
        cd AS (SELECT bm.query_id, chunk_id, score, lower(regexp_replace(d.text, '\s+', '', 'g')) AS body FROM bm JOIN documents d ON d.doc_id = chunk_id),
        cv AS (SELECT cd.query_id, chunk_id, any_value(score) AS score, count(*) FILTER (WHERE contains(body, lower(t))) / count(*) AS cov FROM cd JOIN tm USING (query_id) GROUP BY cd.query_id, chunk_id)
        SELECT query_id, chunk_id, round(cov, 6) AS coverage, round(score + 0.20 * cov, 6) AS score FROM cv""",
)
def coverage_boost(spark, sf_dir):
    pool = with_texts(bm25_hits(spark, sf_dir, 20).select("query_id", "chunk_id", "score"), spark, sf_dir)
    out = rerank.coverage_boost(pool)
    return out.select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


@query(
    "complexity_routed_rerank",
    f"""WITH {Q.bm25_ctes(30)}, {Q.hashed_dense_ctes(30)}, {Q.rrf_ctes(100)}, {COMPLEXITY_SQL},
        cxf AS (SELECT fz.* FROM fz JOIN cp USING (query_id) WHERE score >= 4),
        {_rerank_sql(10, 100, 'cxf')}
        SELECT query_id, chunk_id, rerank_rank, true AS rerank_applied, round(rerank_score, 6) AS rerank_score FROM rr
        UNION ALL SELECT query_id, chunk_id, rank, false, round(fusion_score, 6) FROM fz JOIN cp USING (query_id) WHERE score < 4 AND rank <= 5""",
)
def complexity_routed_rerank(spark, sf_dir):
    """Only complex items (threshold 4 for these long texts) reach the second stage."""
    asked = questions(spark, sf_dir).select("query_id", planning.complexity(F.col("text"), threshold=4.0)["is_complex"].alias("is_complex"))
    pool = fused(spark, sf_dir).join(asked, "query_id")
    out = rerank.routed_rerank(
        pool.drop("matched_terms", "first_seen"), 10, lambda part: rerank.feature_rerank(with_texts(part, spark, sf_dir), 10)
    )
    return out.select(
        "query_id", "chunk_id", F.col("rerank_rank").cast("long").alias("rerank_rank"), "rerank_applied", F.round("rerank_score", 6).alias("rerank_score")
    )


@query("cross_encoder_rerank")
def cross_encoder_rerank(spark, sf_dir):
    """Pair-scored pool of 100 fused candidates through the model seam."""
    pool = with_texts(fused(spark, sf_dir), spark, sf_dir)
    out = rerank.cross_encoder_rerank(pool, 5)
    return out.select("query_id", "chunk_id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"))


def gate_contexts(spark, sf_dir):
    sparse_hits = bm25_hits(spark, sf_dir, 8, with_terms=True).select("query_id", "chunk_id", "rank", F.col("score").alias("bm25_score"), "matched_terms")
    dense = dense_hits(spark, sf_dir, 30).select("query_id", "chunk_id", F.col("score").alias("embedding_score"))
    return sparse_hits.join(dense, ["query_id", "chunk_id"], "left").withColumn("embedding_score", F.coalesce("embedding_score", F.lit(0.0)))


GATE_SQL = f"""{Q.bm25_ctes(8)}, {Q.hashed_dense_ctes(30)},
    mt AS (SELECT bm.query_id, bm.chunk_id, count(*) FILTER (WHERE length(term) > 1) AS m FROM bm JOIN qt USING (query_id) JOIN tf USING (term) WHERE tf.doc_id = bm.chunk_id GROUP BY ALL),
    gx AS (SELECT bm.query_id, bm.rank, bm.score AS b, coalesce(dn.score, 0) AS e, coalesce(m, 0) AS m FROM bm LEFT JOIN dn USING (query_id, chunk_id) LEFT JOIN mt USING (query_id, chunk_id)),
    gs AS (SELECT query_id, max(b) FILTER (WHERE rank = 1) AS b, max(e) FILTER (WHERE rank = 1) AS e, max(m) FILTER (WHERE rank = 1) AS m, bool_or(m >= 2 AND (b >= 0.4 OR e >= 0.4)) AS relaxed FROM gx GROUP BY query_id)"""


@query(
    "evidence_gate",
    f"""WITH {GATE_SQL}
        SELECT query_id, CASE WHEN e >= 0.48 OR (b >= 1 AND m > 0 AND (e >= 0.32 OR m >= 2)) THEN 'relevant' WHEN b >= 1 AND m > 0 THEN 'ambiguous' WHEN e >= 0.32 THEN 'ambiguous' ELSE 'irrelevant' END AS status,
          e >= 0.48 OR (b >= 1 AND m > 0) AS sufficient, round(b, 6) AS bm25, round(e, 6) AS embedding, m AS meaningful FROM gs""",
)
def evidence_gate(spark, sf_dir):
    out = evidence.evidence_gate(gate_contexts(spark, sf_dir))
    return out.select(
        "query_id", "status", "sufficient", F.round("bm25", 6).alias("bm25"), F.round("embedding", 6).alias("embedding"), F.col("meaningful").cast("long").alias("meaningful")
    )


@query(
    "evidence_gate_relaxed",
    f"""WITH {GATE_SQL}
        SELECT query_id, CASE WHEN relaxed THEN 'relaxed' WHEN e >= 0.48 OR (b >= 1 AND m > 0 AND (e >= 0.32 OR m >= 2)) THEN 'clear' WHEN b >= 1 AND m > 0 THEN 'partial' WHEN e >= 0.32 THEN 'semantic_only' ELSE 'none' END AS gate_case FROM gs""",
)
def evidence_gate_relaxed(spark, sf_dir):
    return evidence.evidence_gate(gate_contexts(spark, sf_dir), mode="relaxed").select("query_id", "gate_case")


@query(
    "retrieval_confidence",
    f"""WITH {Q.bm25_ctes(1)}
        SELECT query_id, CASE WHEN score >= 12 AND score >= 8 THEN 'accept' ELSE 'verify' END AS decision FROM bm""",
)
def retrieval_confidence(spark, sf_dir):
    """Best chunk per item with its lexical score as keyword score."""
    top = bm25_hits(spark, sf_dir, 1).select("query_id", "score", F.col("score").alias("keyword_score"), F.lit(0.0).alias("embedding_score"))
    return evidence.retrieval_confidence(top, auto_accept=True, accept_score=12.0).select("query_id", "decision")


@query(
    "threshold_range_join",
    """WITH q AS (SELECT o_orderkey AS query_id, o_custkey % 30 AS target FROM orders),
        l AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_linenumber * 5 - 5 AS lower, l_linenumber * 5 AS upper, CAST(min(l_quantity) AS INTEGER) || ' 日' AS result_text FROM lineitem GROUP BY l_orderkey, l_linenumber),
        h AS (SELECT query_id, rank, result_text, target FROM q JOIN l USING (query_id) WHERE target >= lower AND target < upper),
        b AS (SELECT query_id, min(rank) AS rank FROM h GROUP BY 1)
        SELECT query_id, rank, result_text, CAST(target AS DOUBLE) AS target FROM h JOIN b USING (query_id, rank)""",
)
def threshold_range_join(spark, sf_dir):
    """Duration questions from orders against the range lines of their own items."""
    asked = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), F.concat(F.lit("服務滿"), F.col("o_custkey") % 30, F.lit("個月特休幾天")).alias("question")
    )
    n = F.col("l_linenumber")
    line = F.concat(
        (n * 5 - 5).cast("string"), F.lit("個月以上 "), (n * 5).cast("string"), F.lit("個月未滿："), F.col("l_quantity").cast("int").cast("string"), F.lit(" 日")
    )
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    contexts = lines.select(
        F.col("l_orderkey").alias("query_id"), n.alias("rank"), F.lit("特休天數").alias("title"), line.alias("content")
    )
    return evidence.resolve_threshold(asked, contexts).select("query_id", "rank", "result_text", "target")


def top_contexts(spark, sf_dir, k):
    return with_texts(bm25_hits(spark, sf_dir, k).select("query_id", "chunk_id", "rank"), spark, sf_dir).withColumnRenamed("chunk_text", "content")


FINE_SQL = f"""{Q.bm25_ctes(3)},
    cx AS (SELECT query_id, bm.rank, {clean_sql('d.text')} AS body FROM bm JOIN documents d ON d.doc_id = chunk_id),
    st1 AS (SELECT query_id, rank, unnest(range(1, len(ss) + 1)) AS si, {trim_sql('unnest(ss)')} AS s FROM (SELECT query_id, rank, string_split(regexp_replace(body, '([。！？；;])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM cx)),
    st2 AS (SELECT query_id, rank, s, row_number() OVER (PARTITION BY query_id, rank ORDER BY si) - 1 AS sentence_index FROM st1 WHERE s <> ''),
    wn0 AS (SELECT query_id, rank, sentence_index, unnest(range(0, CASE WHEN length(s) <= 240 THEN 1 ELSE CAST(ceil((length(s) - 240) / 208.0) AS BIGINT) + 1 END)) AS wi, s FROM st2),
    wn1 AS (SELECT query_id, rank, sentence_index, wi, {trim_sql('substr(s, wi * 208 + 1, 240)')} AS content FROM wn0),
    wn2 AS (SELECT query_id, rank, sentence_index, content, row_number() OVER (PARTITION BY query_id, rank, sentence_index ORDER BY wi) - 1 AS window_index FROM wn1 WHERE content <> ''),
    fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, sentence_index, window_index) - 1 AS unit_index FROM wn2 WHERE length(content) >= 8)"""


@query(
    "fine_evidence_units",
    f"""WITH {FINE_SQL} SELECT query_id, rank, sentence_index, window_index, unit_index, md5(content) AS content_md5 FROM fu""",
)
def fine_evidence_units(spark, sf_dir):
    units = evidence.fine_units(top_contexts(spark, sf_dir, 3))
    return units.select(
        "query_id", *[F.col(c).cast("long").alias(c) for c in ("rank", "sentence_index", "window_index", "unit_index")], F.md5("content").alias("content_md5")
    )


@query(
    "fine_evidence_islands",
    f"""WITH {FINE_SQL},
        qk AS (SELECT item_id AS query_id, list_distinct({Q.tokens('text')}) AS qt2 FROM benchmark),
        sc AS (SELECT fu.*, len(list_intersect(qt2, list_distinct({Q.tokens('content')}))) / len(qt2) AS cov FROM fu JOIN qk USING (query_id)),
        ch AS (SELECT *, lag(rank) OVER w AS pr, lag(sentence_index) OVER w AS ps FROM sc WHERE cov >= 0.2 WINDOW w AS (PARTITION BY query_id ORDER BY rank, sentence_index, window_index)),
        il AS (SELECT *, sum(CASE WHEN pr = rank AND sentence_index <= ps + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank, sentence_index, window_index ROWS UNBOUNDED PRECEDING) AS island FROM ch),
        g AS (SELECT query_id, island, max(cov) AS score, min(rank) AS original_rank, min(unit_index) AS first_unit, count(*) AS unit_count FROM il GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, original_rank, first_unit) AS rank FROM g)
        SELECT query_id, rank, round(score, 6) AS score, original_rank, first_unit, unit_count FROM r WHERE rank <= 3""",
)
def fine_evidence_islands(spark, sf_dir):
    """Units covering a fifth of the question, merged into neighbouring groups."""
    units = evidence.fine_units(top_contexts(spark, sf_dir, 3))
    asked = questions(spark, sf_dir).select("query_id", F.array_distinct(bm25_tokens("text")).alias("tokens"))
    scored = units.join(asked, "query_id").withColumn(
        "fine_score", F.size(F.array_intersect("tokens", bm25_tokens("content"))) / F.size("tokens")
    )
    chosen = scored.filter("fine_score >= 0.2").withColumn("lexical", F.col("fine_score")).withColumn("dense", F.lit(0.0)).drop("tokens")
    out = evidence.fine_islands(chosen)
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"),
        F.col("original_rank").cast("long").alias("original_rank"), F.col("first_unit").cast("long").alias("first_unit"), "unit_count",
    )


@query("focus_evidence")
def focus_evidence(spark, sf_dir):
    """Best sentence units of the top three documents per item (greedy near-copy removal)."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    out = evidence.focus_evidence(top_contexts(spark, sf_dir, 3), asked)
    return out.select("query_id", "position", "unit_index", F.round("score", 6).alias("score"), F.md5("content").alias("content_md5"))


@query("fine_evidence")
def fine_evidence(spark, sf_dir):
    """Second-pass evidence: scored windows, greedy choice, grouped and ranked."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "question")
    units = evidence.fine_units(top_contexts(spark, sf_dir, 3))
    chosen = evidence.select_fine_units(evidence.fine_scores(units, asked))
    out = evidence.fine_islands(chosen)
    return out.select("query_id", "rank", F.round("score", 6).alias("score"), "unit_count", F.md5("content").alias("content_md5"))


@query(
    "snippet_scores",
    rf"""WITH x AS (SELECT conv_id, turn, {clean_sql('text')} AS t FROM conversations),
        p AS (SELECT conv_id, turn, unnest(range(1, len(ss) + 1)) AS i, {trim_sql('unnest(ss)')} AS s FROM (SELECT conv_id, turn, string_split(regexp_replace(t, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)) AS ss FROM x)),
        w AS (SELECT conv_id, turn, i, unnest(CASE WHEN length(s) <= 220 THEN [0] ELSE range(0, length(s), 180) END) AS o, s FROM p WHERE s <> ''),
        n AS (SELECT conv_id, turn, {trim_sql('substr(s, o + 1, 220)')} AS c FROM w)
        SELECT conv_id, turn, count(*) AS n_snippets, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM n WHERE c <> '' GROUP BY ALL""",
)
def snippet_scores(spark, sf_dir):
    """Answer snippets of every conversation turn."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(evidence.snippets(F.col("text"))).alias("c"))
    return turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n_snippets"), F.sum(F.length("c")).alias("n_chars"))


@query("structured_lines")
def structured_lines(spark, sf_dir):
    """Structured evidence lines of all documents with their category for a result question."""
    policy = evidence.evidence_policy(F.lit("list all failed task results"))
    rows = spread(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.explode(evidence.structural_lines(F.col("text"))).alias("line"))
    kv = evidence.split_key_value(F.col("line"))
    return rows.withColumn("kv", kv).withColumn("policy", policy).select(
        "doc_id", F.col("kv.key").alias("key"), evidence.line_category(F.col("line"), F.col("kv"), F.col("policy")).alias("category")
    )


@query(
    "keyword_variants",
    f"""WITH q AS (SELECT item_id AS query_id, {clean_sql('text')} AS t FROM benchmark)
        SELECT query_id, count(*) AS n_variants, round(sum(w), 6) AS total_weight FROM (
          SELECT query_id, unnest([1.0, 1.1, 1.0, 0.85])::DOUBLE AS w, unnest([t, t, array_to_string(list_slice(regexp_extract_all(t, '[A-Za-z0-9_.-]+'), 1, 1), ' '), t]) AS v FROM q) WHERE v <> '' GROUP BY query_id""",
)
def keyword_variants(spark, sf_dir):
    """The four weighted variants of every item."""
    rows = questions(spark, sf_dir).select(
        "query_id",
        F.explode(planning.keyword_variants(F.col("text"), clean_spaces(F.col("text")), F.slice(find_all(F.col("text"), "[A-Za-z0-9_.-]+"), 1, 1))).alias("v"),
    )
    return rows.groupBy("query_id").agg(F.count("*").alias("n_variants"), F.round(F.sum("v.weight"), 6).alias("total_weight"))


@query(
    "event_evidence_lines",
    """WITH l AS (SELECT event_id, unnest(['status: ' || event_type, 'owner: user ' || user_id, 'vote: ' || CASE WHEN value > 50 THEN 'yes' ELSE 'no' END, 'note ' || CAST(json_extract(props, '$.k') AS VARCHAR)]) AS line, unnest([1, 2, 3, 4]) AS i, event_type FROM events),
        c AS (SELECT event_id, line, i, CASE WHEN i = 1 THEN 0 WHEN i = 2 THEN 3 WHEN i = 3 THEN NULL ELSE NULL END AS category FROM l)
        SELECT category, count(*) AS n, count(DISTINCT line) AS n_lines FROM c WHERE category IS NOT NULL GROUP BY category""",
)
def event_evidence_lines(spark, sf_dir):
    """Events as records of ``key: value`` lines, judged for a list question on results."""
    rendered = F.concat_ws(
        "\n",
        F.concat(F.lit("status: "), F.col("event_type")),
        F.concat(F.lit("owner: user "), F.col("user_id")),
        F.concat(F.lit("vote: "), F.when(F.col("value") > 50, "yes").otherwise("no")),
        F.concat(F.lit("note "), F.get_json_object("props", "$.k")),
    )
    records = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), F.lit(1).alias("rank"), F.lit("event").alias("title"), rendered.alias("content")
    )
    asked = records.select("query_id", F.lit("list all failed task results").alias("question"))
    out = evidence.evidence_lines(records, asked)
    return out.groupBy(F.col("category")).agg(F.count("*").alias("n"), F.countDistinct("line").alias("n_lines"))


@query(
    "event_list_search",
    """SELECT event_type, count(*) AS n FROM (SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error') ORDER BY event_id LIMIT 12) GROUP BY event_type""",
)
def event_list_search(spark, sf_dir):
    """Records whose result field names a requested outcome, in sequence order, first twelve."""
    outcome = F.when(F.col("event_type") == "purchase", "成功").when(F.col("event_type") == "error", "失敗").otherwise("未知")
    chunks = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("chunk_id"),
        F.concat(F.lit("第"), F.col("event_id"), F.lit("輪")).alias("title"),
        F.concat(F.lit("結果："), outcome, F.lit("\nevent_type: "), F.col("event_type")).alias("content"),
        "event_type",
    )
    asked = chunks.agg(F.count("*").alias("n")).select(F.lit(1).alias("query_id"), F.lit("哪些任務成功或失敗").alias("question"))
    hits = evidence.event_list_chunks(asked, chunks.drop("event_type"))
    return hits.join(chunks.select("chunk_id", "event_type"), "chunk_id").groupBy("event_type").agg(F.count("*").alias("n"))
