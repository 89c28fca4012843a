"""Persisted indexes, scoped retrieval, passages found again, page and section gold."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.operators import metrics, scoped, sparse, spans
from corpusmill.operators.embed import embed
from corpusmill.operators.postings import PostingStore
from corpusmill.plans import sqltext as Q
from corpusmill.plans.answer_queries import PASSAGE_SQL, gold_spans, retrieved_spans
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import hits_out, questions
from corpusmill.plans.stores import corpus, files_digest, folder, written
from corpusmill.session import read_table

LARGEST_SOURCE = "(SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


def changed_index(spark, sf_dir):
    """Index grown language by language, offered every source again, and freed of the largest source.

    Built once per state of the table; each step may be repeated after a failure.
    """
    documents = read_table(spark, sf_dir, "documents")
    store = PostingStore(spark, folder(spark, "changed", files_digest(documents)), merge_at=3)
    if any(e["kind"] == "delete" for e in store.entries()):
        return store
    vectors = sparse.build_index(corpus(spark, sf_dir).withColumn("source_id", F.concat_ws(":", "lang", "source_id")), "text", source_id="source_id").vectors
    language = F.substring_index("source_id", ":", 1)
    for lang in sorted(r["lang"] for r in documents.where("lang IS NOT NULL").select("lang").distinct().collect()):
        store.add(vectors.where(language == lang))
    added, refused = store.add(vectors)
    if added or not refused:
        raise RuntimeError("sources that the index holds were added again")
    sizes = documents.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "source").limit(1)
    names = store.docs().select("source_id").distinct().join(F.broadcast(largest), F.substring_index("source_id", ":", -1) == F.col("source"), "left_semi")
    store.delete(names)
    return store


@query(
    "index_incremental_add",
    f"WITH {Q.bm25_ctes(10, corpus=f'SELECT doc_id, source, text FROM documents WHERE source IS DISTINCT FROM {LARGEST_SOURCE}')} "
    "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm",
)
def index_incremental_add(spark, sf_dir):
    """Search after adds, a merge and a delete equals one over the rows that are left."""
    return hits_out(changed_index(spark, sf_dir).search(questions(spark, sf_dir), 10))


@query(
    "index_term_statistics",
    f"""WITH d AS (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents WHERE source IS DISTINCT FROM {LARGEST_SOURCE}),
        st AS (SELECT count(*) AS n, avg(greatest(len(toks), 1)) AS a FROM d)
        SELECT term, count(DISTINCT doc_id) AS df, (SELECT n FROM st) AS n_chunks, round((SELECT a FROM st), 6) AS mean_length
        FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY term""",
)
def index_term_statistics(spark, sf_dir):
    store = changed_index(spark, sf_dir)
    count, mean = store.statistics()
    return store.document_frequency().select("term", "df", F.lit(count).cast("long").alias("n_chunks"), F.round(F.lit(mean), 6).alias("mean_length"))


@query(
    "index_describe",
    f"""SELECT lang || ':' || source AS source_id, CASE WHEN lang = 'en' THEN 'English ' || source ELSE lang || ':' || source END AS name,
          CASE WHEN lang = 'en' THEN 'corpus' ELSE 'document' END AS source_type, CAST(count(*) FILTER (source <> {LARGEST_SOURCE}) AS BIGINT) AS chunk_count,
          lang = 'en' AS selected_by_default, 'ready' AS status
        FROM documents WHERE lang = 'en' OR source <> {LARGEST_SOURCE} GROUP BY lang, source""",
)
def index_describe(spark, sf_dir):
    """Sources with their live chunks; English ones are described, the others known from the index."""
    known = corpus(spark, sf_dir).where("lang = 'en'").select(
        F.concat_ws(":", "lang", "source_id").alias("source_id"), F.concat(F.lit("English "), "source_id").alias("name"), F.lit("corpus").alias("source_type"), F.lit(True).alias("selected_by_default")
    ).distinct()
    return changed_index(spark, sf_dir).describe(known)


PASSAGE_WORDS = 40


@query(
    "normalised_gold_spans",
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS ts FROM documents),
        w AS (SELECT doc_id, unnest(range(len(ts))) AS i, unnest(ts) AS t FROM t),
        p AS (SELECT doc_id, i, length(ltrim(t, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))) AS n, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM w),
        g AS (SELECT doc_id, i // {PASSAGE_WORDS} AS passage_no, CAST(min(e - n) AS BIGINT) AS span_start, CAST(max(e) AS BIGINT) AS span_end FROM p GROUP BY ALL),
        f AS (SELECT doc_id, max(passage_no) + 1 AS passage_no FROM g GROUP BY 1)
        SELECT doc_id, passage_no, span_start, span_end, TRUE AS exact, TRUE AS found FROM g
        UNION ALL SELECT f.doc_id, f.passage_no, span_start, span_end, FALSE, TRUE FROM f JOIN g ON g.doc_id = f.doc_id AND g.passage_no = 0""",
)
def normalised_gold_spans(spark, sf_dir):
    """Normalised passages of every document, and its first one again after them, found in the raw text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.split(spans.normalised("text"), " ")
    cut = docs.where(spans.normalised("text") != "").select("doc_id", words.alias("w"))
    pieces = cut.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PASSAGE_WORDS)), lambda i: F.array_join(F.slice("w", i * PASSAGE_WORDS + 1, PASSAGE_WORDS), " "))).alias("passage_no", "content"), F.ceil(F.size("w") / PASSAGE_WORDS).cast("int").alias("n"))
    again = pieces.where("passage_no = 0").select("doc_id", F.col("n").alias("passage_no"), "content")
    passages = pieces.select("doc_id", "passage_no", "content").unionByName(again).withColumn("passage_no", F.col("passage_no").cast("long"))
    return spans.locate_passages(docs, passages)


def part_recall(spark, sf_dir, parts):
    """Recall of gold parts (sections, pages) of documents by retrieved passages."""
    found = retrieved_spans(spark, sf_dir).select(F.col("file_id"), F.struct("query_id", "rank", "start", "end").alias("left_id"), "start", "end")
    gold = gold_spans(spark, sf_dir).select(F.col("file_id"), F.struct("query_id", "span_no").alias("left_id"), "start", "end")
    into = lambda df: spans.overlaps(df, parts, "file_id").select(F.col("left_id.query_id").alias("query_id"), "file_id", F.col("right_id").alias("part_no"), "left_id")
    return metrics.part_recall(into(found), into(gold), questions(spark, sf_dir))


def sections(spark, sf_dir):
    """Lines of documents as spans: the sections of these texts."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.split("text", "\n", -1).alias("lines"))
    rows = docs.select("file_id", F.posexplode("lines").alias("right_id", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("file_id").orderBy("right_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("file_id", F.col("right_id").cast("long").alias("right_id"), before.alias("start"), (before + F.length("line")).alias("end"))


PAGE_CHARS = 1000


def pages_of_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("file_id"), F.length("text").alias("n"))
    rows = docs.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PAGE_CHARS))).alias("right_id"))
    return rows.select("file_id", "right_id", (F.col("right_id") * PAGE_CHARS).alias("start"), F.least(F.col("n").cast("long"), (F.col("right_id") + 1) * PAGE_CHARS).alias("end"))


def part_recall_sql(parts: str) -> str:
    return f"""WITH {PASSAGE_SQL},
        pt AS ({parts}),
        rp AS (SELECT DISTINCT query_id, rt.file_id, part_no FROM rt JOIN pt ON pt.file_id = rt.file_id AND least(rt.e, pt.e) > greatest(rt.s, pt.s)),
        gp AS (SELECT DISTINCT query_id, gs.file_id, part_no FROM gs JOIN pt ON pt.file_id = gs.file_id AND least(gs.ge, pt.e) > greatest(gs.gs, pt.s)),
        q AS (SELECT item_id AS query_id FROM benchmark),
        gd AS (SELECT query_id, count(DISTINCT file_id) AS gold_docs, count(*) AS gold_parts FROM gp GROUP BY 1),
        hd AS (SELECT query_id, count(DISTINCT file_id) AS docs FROM rp SEMI JOIN (SELECT DISTINCT query_id, file_id FROM gp) USING (query_id, file_id) GROUP BY 1),
        hp AS (SELECT query_id, count(*) AS parts FROM rp SEMI JOIN gp USING (query_id, file_id, part_no) GROUP BY 1)
        SELECT query_id, coalesce(gold_docs, 0) AS gold_docs, coalesce(gold_parts, 0) AS gold_parts, round(CASE WHEN gold_docs > 0 THEN coalesce(docs, 0) / gold_docs ELSE 0 END, 8) AS document_recall,
          round(CASE WHEN gold_parts > 0 THEN coalesce(parts, 0) / gold_parts ELSE 0 END, 8) AS part_recall, coalesce(parts, 0) > 0 AS any_evidence_hit
        FROM q LEFT JOIN gd USING (query_id) LEFT JOIN hd USING (query_id) LEFT JOIN hp USING (query_id)"""


@query(
    "section_recall",
    part_recall_sql(
        """SELECT file_id, part_no, CAST(sum(n + 1) OVER (PARTITION BY file_id ORDER BY part_no) - n - 1 AS BIGINT) AS s, CAST(sum(n + 1) OVER (PARTITION BY file_id ORDER BY part_no) - 1 AS BIGINT) AS e
        FROM (SELECT doc_id AS file_id, unnest(range(len(string_split(text, chr(10))))) AS part_no, length(unnest(string_split(text, chr(10)))) AS n FROM documents)"""
    ),
)
def section_recall(spark, sf_dir):
    """Sections of gold passages that the retrieved passages touch."""
    return part_recall(spark, sf_dir, sections(spark, sf_dir))


@query(
    "page_recall",
    part_recall_sql(
        f"SELECT doc_id AS file_id, k // {PAGE_CHARS} AS part_no, k AS s, least(length(text), k + {PAGE_CHARS}) AS e FROM documents, unnest(range(0, length(text), {PAGE_CHARS})) u(k)"
    ),
)
def page_recall(spark, sf_dir):
    """Pages of gold passages that the retrieved passages touch."""
    return part_recall(spark, sf_dir, pages_of_documents(spark, sf_dir))


SCOPED_QUESTIONS_SQL = """
    qs AS (SELECT item_id AS query_id, text, (['en', 'de', 'fr', 'es'])[item_id % 4 + 1] AS tenant, 'src' || (item_id // 4 % 20) AS kb, item_id % 7 <> 6 AS versioned FROM benchmark)"""


def scoped_sql(k: int, pool: int) -> str:
    """Per-scope BM25 and hashed dense lists, fused."""
    bucket, words = "CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64", "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[㐀-鿿]')"
    return f"""WITH {SCOPED_QUESTIONS_SQL},
    d AS (SELECT doc_id, lang, source, {Q.tokens('text')} AS toks FROM documents),
    dl AS (SELECT doc_id, lang, source, greatest(len(toks), 1) AS dl FROM d),
    st AS (SELECT lang, source, count(*) AS n, avg(dl) AS a FROM dl GROUP BY ALL),
    tf AS (SELECT doc_id, lang, source, term, count(*) AS tf FROM (SELECT doc_id, lang, source, unnest(toks) AS term FROM d) GROUP BY ALL),
    df AS (SELECT lang, source, term, count(*) AS df FROM tf GROUP BY ALL),
    qt AS (SELECT query_id, tenant, kb, term, count(*) AS qf FROM (SELECT query_id, tenant, kb, unnest({Q.tokens('text')}) AS term FROM qs WHERE versioned) GROUP BY ALL),
    bms AS (SELECT query_id, tf.doc_id AS chunk_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf * 2.4) / (tf.tf + 1.4 * (1 - 0.72 + 0.72 * dl.dl / st.a)) * (1 + ln(qf))) AS score
      FROM qt JOIN tf ON tf.term = qt.term AND tf.lang = tenant AND tf.source = kb JOIN df ON df.term = qt.term AND df.lang = tenant AND df.source = kb JOIN st ON st.lang = tenant AND st.source = kb JOIN dl ON dl.doc_id = tf.doc_id GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bms WHERE score > 0) WHERE rank <= {pool}),
    cv AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, {bucket} AS b FROM (SELECT doc_id, unnest({words}) AS w FROM documents)) GROUP BY ALL),
    qv AS (SELECT query_id, b, count(*) AS c FROM (SELECT query_id, {bucket} AS b FROM (SELECT query_id, unnest({words}) AS w FROM qs)) GROUP BY ALL),
    cn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM cv GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY query_id),
    cand AS (SELECT query_id, doc_id FROM qs JOIN documents ON lang = tenant AND source = kb WHERE versioned),
    pr AS (SELECT query_id, doc_id, sum(qv.c * cv.c) AS d FROM cand JOIN qv USING (query_id) JOIN cv USING (doc_id, b) GROUP BY ALL),
    dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
      (SELECT query_id, doc_id AS chunk_id, coalesce(d / (qn.n * cn.n), 0) AS score FROM cand LEFT JOIN pr USING (query_id, doc_id) LEFT JOIN qn USING (query_id) LEFT JOIN cn USING (doc_id))) WHERE rank <= {pool}),
    {Q.rrf_ctes(k)}
    SELECT query_id, rank, chunk_id, source_id, round(fusion_score, 9) AS fusion_score, round(bm25_score, 6) AS bm25_score, round(embedding_score, 6) AS embedding_score
    FROM fz JOIN (SELECT doc_id AS chunk_id, source AS source_id FROM documents) USING (chunk_id)"""


@query("scoped_retrieve", scoped_sql(5, 30))
def scoped_retrieve(spark, sf_dir):
    """Languages as tenants, sources as their bases: each item is asked in one scope, some without a version."""
    documents = read_table(spark, sf_dir, "documents")
    path = folder(spark, "scoped", files_digest(documents))
    if not written(spark, path):
        chunks = documents.where("lang IS NOT NULL AND source IS NOT NULL").select(
            F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("text").alias("content"), F.col("lang").alias("tenant_id"),
            F.col("source").alias("kb_id"), F.lit("v1").alias("index_version_id"), embed(F.col("text")).alias("embedding"),
        )
        scoped.write_corpus(chunks, path)
    asked = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("").alias("retrieval_query"),
        F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int")).alias("tenant_id"),
        F.concat(F.lit("src"), (F.floor(F.col("item_id") / 4) % 20).cast("string")).alias("kb_id"), F.when(F.col("item_id") % 7 != 6, "v1").alias("index_version_id"),
    )
    out = scoped.scoped_retrieve(asked, spark, path)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "source_id", F.round("fusion_score", 9).alias("fusion_score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("embedding_score", 6).alias("embedding_score"))
