"""Building blocks of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from corpusmill.functions.text import STOP_WORDS

STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), "
        f"lambda t: t NOT IN ({STOP_LIST}))"
    )


def bm25_ctes(
    k: int, k1: float = 1.4, b: float = 0.72, where: str = "TRUE", factor: str = "(1 + ln(qf))",
    corpus: str = "SELECT doc_id, source, text FROM documents",
) -> str:
    """CTEs ending in ``bm(query_id, chunk_id, score, rank)`` over a corpus x benchmark."""
    return f"""
    d AS (SELECT doc_id, source, {tokens('text')} AS toks FROM ({corpus})),
    dl AS (SELECT doc_id, greatest(len(toks), 1) AS dl FROM d),
    st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
    tf AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest(toks) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
    bms AS (
      SELECT query_id, tf.doc_id AS chunk_id,
        sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5))
            * (tf.tf * {k1 + 1.0}) / (tf.tf + {k1} * (1 - {b} + {b} * dl.dl / st.a)) * {factor}) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st
      WHERE {where}
      GROUP BY ALL),
    bm AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bms WHERE score > 0)
      WHERE rank <= {k})"""


def hashed_dense_ctes(k: int) -> str:
    """CTEs ending in ``dn(query_id, chunk_id, score, rank)`` for the hashing embedder."""
    bucket = "CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64"
    words = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[㐀-鿿]')"
    return f"""
    cv AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, {bucket} AS b FROM (SELECT doc_id, unnest({words}) AS w FROM documents)) GROUP BY ALL),
    qv AS (SELECT item_id, b, count(*) AS c FROM (SELECT item_id, {bucket} AS b FROM (SELECT item_id, unnest({words}) AS w FROM benchmark)) GROUP BY ALL),
    cn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM cv GROUP BY doc_id),
    qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY item_id),
    pr AS (SELECT item_id, cv.doc_id, sum(qv.c * cv.c) AS d FROM qv JOIN cv USING (b) GROUP BY ALL),
    dns AS (
      SELECT q.item_id AS query_id, c.doc_id AS chunk_id,
        coalesce(pr.d / (qn.n * cn.n), 0) AS score
      FROM (SELECT item_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) c
      LEFT JOIN pr ON pr.item_id = q.item_id AND pr.doc_id = c.doc_id
      LEFT JOIN qn ON qn.item_id = q.item_id LEFT JOIN cn ON cn.doc_id = c.doc_id),
    dn AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dns)
      WHERE rank <= {k})"""


def rrf_ctes(limit: int, weights: tuple[float, float] = (0.6, 0.4), rrf_k: int = 60) -> str:
    """CTE ``fz`` fusing ``bm`` and ``dn``; ties keep insertion order."""
    return f"""
    ls AS (
      SELECT query_id, chunk_id, rank, score, 0 AS list_no, {weights[0]} AS w FROM bm
      UNION ALL SELECT query_id, chunk_id, rank, score, 1, {weights[1]} FROM dn),
    fs AS (
      SELECT query_id, chunk_id, sum(w / ({rrf_k} + rank)) AS fusion_score,
        greatest(0, coalesce(max(CASE WHEN list_no = 0 THEN score END), 0)) AS bm25_score,
        greatest(0, coalesce(max(CASE WHEN list_no = 1 THEN score END), 0)) AS embedding_score,
        min(list_no * 1000000 + rank) AS seen
      FROM ls GROUP BY ALL),
    fz AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 12) DESC, seen, chunk_id) AS rank FROM fs)
      WHERE rank <= {limit})"""
