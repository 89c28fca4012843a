"""Search, fusion and reranking over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import bm25_tokens, estimate_tokens
from corpusmill.operators import dense, embed, fusion, rerank, sparse
from corpusmill.plans import sqltext as Q
from corpusmill.plans.registry import query
from corpusmill.plans.stores import corpus, document_index, document_vectors
from corpusmill.session import broadcast_bounded, read_table, spread


def questions(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, sf_dir):
    return sparse.build_index(corpus(spark, sf_dir), "text", source_id="source_id")


def bm25_hits(spark, sf_dir, k, **options):
    return sparse.bm25_search(questions(spark, sf_dir), document_index(spark, sf_dir), k, **options)


def dense_hits(spark, sf_dir, k):
    return dense.dense_search(
        questions(spark, sf_dir).withColumn("embedding", embed.embed(F.col("text"))), document_vectors(spark, sf_dir), k
    )


def fused(spark, sf_dir, k=30, limit=100):
    lists = fusion.as_list(bm25_hits(spark, sf_dir, k), 0, "bm25").unionByName(
        fusion.as_list(dense_hits(spark, sf_dir, k), 1, "embedding")
    )
    return fusion.weighted_rrf(lists, limit=limit)


def with_texts(candidates, spark, sf_dir):
    """Attach question and chunk text to at most 100 candidates per question.

    The candidates go to the texts, so the corpus is scanned and not shuffled.
    """
    texts = corpus(spark, sf_dir).select("chunk_id", F.col("text").alias("chunk_text"))
    asked = questions(spark, sf_dir).select("query_id", F.col("text").alias("query_text"))
    few = broadcast_bounded(candidates, asked.count() * 100, 2000)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return texts.join(few, "chunk_id").repartition(partitions, "query_id", "chunk_id").join(asked, "query_id")


def hits_out(hits, *extra):
    return hits.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *extra
    )


@query(
    "tokenize_counts",
    f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_terms,
        md5(array_to_string(toks, ' ')) AS tokens_md5
        FROM (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents)""",
)
def tokenize_counts(spark, sf_dir):
    toks = spread(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", bm25_tokens("text").alias("toks"))
    return toks.select(
        "doc_id",
        F.size("toks").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("long").alias("n_terms"),
        F.md5(F.array_join("toks", " ")).alias("tokens_md5"),
    )


@query(
    "token_estimate",
    r"""SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(max(n) AS BIGINT) AS max_tokens FROM (
        SELECT lang, len(regexp_extract_all(text, '[㐀-鿿]|[A-Za-z]+(?:[''’][A-Za-z]+)?|\d+(?:[.,:/-]\d+)*|[^\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}\x0b]')) AS n FROM documents)
        GROUP BY lang""",
)
def token_estimate(spark, sf_dir):
    counted = spread(read_table(spark, sf_dir, "documents"), "doc_id").select("lang", estimate_tokens("text").alias("n"))
    return counted.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").cast("long").alias("max_tokens")
    )


@query(
    "bm25_stats",
    f"""WITH d AS (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents),
        st AS (SELECT count(*) AS n FROM d),
        df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY term)
        SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st""",
)
def bm25_stats(spark, sf_dir):
    ix = index(spark, sf_dir)
    df = ix.document_frequency()
    return df.withColumn("n", ix.statistics().select("n_chunks").scalar()).select(
        "term", "df", F.round(sparse.idf(F.col("n"), F.col("df")), 6).alias("idf")
    )


@query(
    "bm25_corpus_stats",
    f"""SELECT count(*) AS n_chunks, round(avg(dl), 6) AS avg_length, CAST(max(dl) AS BIGINT) AS max_length
        FROM (SELECT greatest(len({Q.tokens('text')}), 1) AS dl FROM documents)""",
)
def bm25_corpus_stats(spark, sf_dir):
    vectors = index(spark, sf_dir).vectors
    return vectors.agg(
        F.count("*").alias("n_chunks"),
        F.round(F.avg("length"), 6).alias("avg_length"),
        F.max("length").cast("long").alias("max_length"),
    )


@query(
    "stopword_filter",
    f"""SELECT word AS token, count(*) AS n FROM
        (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
        WHERE word IN ({Q.STOP_LIST}) GROUP BY word""",
)
def stopword_filter(spark, sf_dir):
    from corpusmill.functions.text import STOP_WORDS

    words = spread(read_table(spark, sf_dir, "documents"), "doc_id").select(
        F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token")
    )
    return words.filter(F.col("token").isin(*STOP_WORDS)).groupBy("token").agg(F.count("*").alias("n"))


@query(
    "bm25_topk",
    f"WITH {Q.bm25_ctes(20)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm",
)
def bm25_topk(spark, sf_dir):
    return hits_out(bm25_hits(spark, sf_dir, 20))


@query(
    "bm25_filtered_global_stats",
    f"WITH {Q.bm25_ctes(10, where=chr(34) + 'source' + chr(34) + ' IN (SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) WHERE n * 2 >= (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)))')} "
    "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm",
)
def bm25_filtered_global_stats(spark, sf_dir):
    """Candidates restricted to the large sources; statistics stay global."""
    sizes = read_table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("m")).select("m").scalar()
    allowed = sizes.withColumn("m", largest).filter("n * 2 >= m").select(F.col("source").alias("source_id"))
    return hits_out(bm25_hits(spark, sf_dir, 10, allowed=allowed))


@query(
    "bm25_plain_weights",
    f"WITH {Q.bm25_ctes(10, k1=1.5, b=0.75, factor='qf')} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm",
)
def bm25_plain_weights(spark, sf_dir):
    """Experiment variant: k1 1.5, b 0.75, every repeat of a query term counts."""
    return hits_out(bm25_hits(spark, sf_dir, 10, k1=1.5, b=0.75, distinct_terms=False))


@query(
    "term_overlap_topk",
    f"""WITH c AS (SELECT doc_id, list_distinct({Q.tokens('text')}) AS t FROM documents),
        q AS (SELECT item_id, list_distinct({Q.tokens('text')}) AS t FROM benchmark),
        x AS (SELECT item_id, doc_id, count(*) AS shared FROM (SELECT item_id, unnest(t) AS term FROM q) JOIN (SELECT doc_id, unnest(t) AS term FROM c) USING (term) GROUP BY ALL),
        s AS (SELECT item_id AS query_id, doc_id AS chunk_id, shared / sqrt(CAST(len(q.t) AS DOUBLE) * len(c.t)) AS score FROM x JOIN q USING (item_id) JOIN c USING (doc_id))
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
)
def term_overlap_topk(spark, sf_dir):
    return hits_out(sparse.term_overlap_search(questions(spark, sf_dir), index(spark, sf_dir), 10))


CENTROID_SQL = """
    x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
    ct AS (SELECT label, list(m ORDER BY i) AS v FROM x GROUP BY label)"""


def label_centroids(spark, sf_dir):
    return dense.centroids(read_table(spark, sf_dir, "embeddings"), "label")


@query(
    "centroid_by_label",
    f"""WITH {CENTROID_SQL} SELECT label, count(*) AS dims, round(sqrt(sum(m * m)), 6) AS norm, round(sum(m), 6) AS total
        FROM x GROUP BY label""",
)
def centroid_by_label(spark, sf_dir):
    return label_centroids(spark, sf_dir).select(
        "label",
        F.size("embedding").cast("long").alias("dims"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)), 6).alias("norm"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


DENSE_SQL = """
    sc AS (SELECT CAST(q.label AS BIGINT) AS query_id, e.vec_id AS chunk_id, e.label, list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])) AS score FROM ct q CROSS JOIN embeddings e)"""


@query(
    "dense_topk",
    f"""WITH {CENTROID_SQL}, {DENSE_SQL}
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 20""",
)
def dense_topk(spark, sf_dir):
    """Nearest vectors of every label centroid, over the whole table."""
    wanted = label_centroids(spark, sf_dir).withColumnRenamed("label", "query_id")
    chunks = read_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return hits_out(dense.dense_search(wanted, chunks, 20))


@query(
    "dense_filtered_topk",
    f"""WITH {CENTROID_SQL}, {DENSE_SQL},
        al AS (SELECT label FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) WHERE n >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)))
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE label IN (SELECT label FROM al)) WHERE rank <= 10""",
)
def dense_filtered_topk(spark, sf_dir):
    """Same search when only the labels of at least mean size may answer."""
    vectors = read_table(spark, sf_dir, "embeddings")
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n"))
    allowed = (
        sizes.withColumn("m", sizes.agg(F.avg("n").alias("m")).select("m").scalar())
        .filter("n >= m")
        .select(F.col("label").alias("source_id"))
    )
    wanted = label_centroids(spark, sf_dir).withColumnRenamed("label", "query_id")
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source_id"), "embedding")
    return hits_out(dense.dense_search(wanted, chunks, 10, allowed=allowed))


@query(
    "dense_scoped_topk",
    f"""WITH {CENTROID_SQL}, {DENSE_SQL}
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc WHERE label = query_id) WHERE rank <= 10""",
)
def dense_scoped_topk(spark, sf_dir):
    """Every centroid only sees the vectors of its own label."""
    wanted = label_centroids(spark, sf_dir).select(F.col("label").alias("query_id"), F.col("label").alias("source_id"), "embedding")
    chunks = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("source_id"), "embedding"
    )
    hits = dense.scoped_dense_search(wanted, chunks, 10)
    return hits_out(hits.withColumn("query_id", F.col("query_id").cast("long")))


@query(
    "text_dense_topk",
    f"WITH {Q.hashed_dense_ctes(20)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dn",
)
def text_dense_topk(spark, sf_dir):
    return hits_out(dense_hits(spark, sf_dir, 20))


@query(
    "rrf_fusion",
    f"""WITH {Q.bm25_ctes(30)}, {Q.hashed_dense_ctes(30)}, {Q.rrf_ctes(100)}
        SELECT query_id, chunk_id, rank, round(fusion_score, 8) AS fusion_score, round(bm25_score, 6) AS bm25_score, round(embedding_score, 6) AS embedding_score FROM fz""",
)
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select(
        "query_id",
        "chunk_id",
        F.col("rank").cast("long").alias("rank"),
        F.round("fusion_score", 8).alias("fusion_score"),
        F.round("bm25_score", 6).alias("bm25_score"),
        F.round("embedding_score", 6).alias("embedding_score"),
    )


@query(
    "rrf_rank_ties",
    f"""WITH {Q.bm25_ctes(20)}, {Q.hashed_dense_ctes(20)},
        j AS (SELECT query_id, chunk_id, bm.rank AS br, dn.rank AS er,
              coalesce(0.6 / (60 + bm.rank), 0) + coalesce(0.4 / (60 + dn.rank), 0) AS s FROM bm FULL OUTER JOIN dn USING (query_id, chunk_id))
        SELECT query_id, chunk_id, rank, round(s, 8) AS rrf_score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, coalesce(br, 1000000000), coalesce(er, 1000000000), chunk_id) AS rank FROM j)
        WHERE rank <= 20""",
)
def rrf_rank_ties(spark, sf_dir):
    out = fusion.rank_tie_rrf(bm25_hits(spark, sf_dir, 20), dense_hits(spark, sf_dir, 20), 20)
    return out.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("rrf_score", 8).alias("rrf_score")
    )


@query(
    "raw_weighted_fusion",
    f"""WITH {Q.bm25_ctes(20)}, {Q.hashed_dense_ctes(20)}
        SELECT query_id, chunk_id, round(coalesce(bm.score, 0), 6) AS bm25_score, round(coalesce(dn.score, 0), 6) AS embedding_score,
          round(0.5 * coalesce(bm.score, 0) + 0.5 * coalesce(dn.score, 0), 6) AS fusion_score
        FROM bm FULL OUTER JOIN dn USING (query_id, chunk_id)""",
)
def raw_weighted_fusion(spark, sf_dir):
    out = fusion.raw_fusion(bm25_hits(spark, sf_dir, 20), dense_hits(spark, sf_dir, 20))
    return out.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25_score", "embedding_score", "fusion_score")])


RANK_MAP_SQL = """
    rm AS (SELECT *, round(bm25_score, 9) AS b9, round(embedding_score, 9) AS e9, count(*) OVER (PARTITION BY query_id) AS n FROM fz),
    rp AS (SELECT *,
      CASE WHEN b9 <= 0 THEN 0 WHEN n = 1 THEN 1 ELSE (rank() OVER (PARTITION BY query_id ORDER BY b9) + (count(*) OVER (PARTITION BY query_id, b9) - 1) / 2.0 - 1) / (n - 1) END AS mb,
      CASE WHEN e9 <= 0 THEN 0 WHEN n = 1 THEN 1 ELSE (rank() OVER (PARTITION BY query_id ORDER BY e9) + (count(*) OVER (PARTITION BY query_id, e9) - 1) / 2.0 - 1) / (n - 1) END AS me FROM rm)"""


@query(
    "rank_map_fusion",
    f"""WITH {Q.bm25_ctes(30)}, {Q.hashed_dense_ctes(30)}, {Q.rrf_ctes(100)}, {RANK_MAP_SQL}
        SELECT query_id, chunk_id, round(mb, 6) AS mapped_bm25_score, round(me, 6) AS mapped_embedding_score, round(0.6 * mb + 0.4 * me, 6) AS score FROM rp""",
)
def rank_map_fusion(spark, sf_dir):
    out = fusion.rank_map_fusion(fused(spark, sf_dir), 0.6, 0.4)
    return out.select(
        "query_id",
        "chunk_id",
        F.round("mapped_bm25_score", 6).alias("mapped_bm25_score"),
        F.round("mapped_embedding_score", 6).alias("mapped_embedding_score"),
        F.round("lambda_mart_fusion_score", 6).alias("score"),
    )


@query(
    "minmax_fusion",
    f"""WITH {Q.bm25_ctes(30)}, {Q.hashed_dense_ctes(30)}, {Q.rrf_ctes(100)},
        mm AS (SELECT *, min(bm25_score) OVER w AS lb, max(bm25_score) OVER w AS hb, min(embedding_score) OVER w AS le, max(embedding_score) OVER w AS he FROM fz WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, chunk_id,
          round(CASE WHEN hb - lb <= 1e-12 THEN CASE WHEN bm25_score > 0 THEN 1 ELSE 0 END ELSE (bm25_score - lb) / (hb - lb) END, 6) AS scaled_bm25,
          round(CASE WHEN he - le <= 1e-12 THEN CASE WHEN embedding_score > 0 THEN 1 ELSE 0 END ELSE (embedding_score - le) / (he - le) END, 6) AS scaled_embedding
        FROM mm""",
)
def minmax_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select(
        "query_id",
        "chunk_id",
        F.round(fusion.min_max(F.col("bm25_score"), "query_id"), 6).alias("scaled_bm25"),
        F.round(fusion.min_max(F.col("embedding_score"), "query_id"), 6).alias("scaled_embedding"),
    )


def _rerank_sql(k, pool, source="fz"):
    return f"""
    qq AS (SELECT item_id AS query_id, text AS qtext, list_distinct({Q.tokens('text')}) AS qt,
             regexp_extract_all(lower(text), '[a-z0-9]+(?:\\s+[a-z0-9]+){{1,5}}') AS ph FROM benchmark),
    cc AS (SELECT doc_id AS chunk_id, lower(text) AS ctext, list_distinct({Q.tokens('text')}) AS ct FROM documents WHERE doc_id IN (SELECT chunk_id FROM {source})),
    fe AS (SELECT f.*, len(list_intersect(qt, ct)) / greatest(len(qt), 1) AS coverage,
             CASE WHEN len(list_filter(ph, lambda p: contains(ctext, p))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase,
             max(bm25_score) OVER w AS mb, max(fusion_score) OVER w AS mf, min(embedding_score) OVER w AS le, max(embedding_score) OVER w AS he
           FROM {source} f JOIN qq USING (query_id) JOIN cc USING (chunk_id) WINDOW w AS (PARTITION BY query_id)),
    fr AS (SELECT *, 0.30 * fusion_score / mf + CASE WHEN mb <> 0 THEN 0.32 * bm25_score / mb ELSE 0 END + 0.26 * (embedding_score - le) / greatest(he - le, 1e-9) + 0.10 * coverage + 0.02 * phrase AS rerank_score FROM fe),
    rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank, chunk_id) AS rerank_rank FROM fr) WHERE rerank_rank <= {k})"""


@query(
    "feature_rerank",
    f"""WITH {Q.bm25_ctes(30)}, {Q.hashed_dense_ctes(30)}, {Q.rrf_ctes(100)}, {_rerank_sql(10, 100)}
        SELECT query_id, chunk_id, rerank_rank, round(coverage, 6) AS coverage, phrase, round(rerank_score, 6) AS rerank_score FROM rr""",
)
def feature_rerank(spark, sf_dir):
    pool = with_texts(fused(spark, sf_dir), spark, sf_dir)
    return rerank.feature_rerank(pool, 10).select(
        "query_id",
        "chunk_id",
        F.col("rerank_rank").cast("long").alias("rerank_rank"),
        F.round("coverage", 6).alias("coverage"),
        "phrase",
        F.round("rerank_score", 6).alias("rerank_score"),
    )
