"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import blocks, impact, infill, jaccard, outliers, packing, prefixtrie, secretscan, sharding, tiling, toxicity, urlrank, warc
from corpusmill.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# (action, host, path) of the url rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_channel_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op2_impact_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_products(read_table(spark, sf_dir, "embeddings"))


def _url_sql() -> str:
    """The link-graph judgement with the rounds written out."""
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'" for a, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    d = urlrank.DAMPING
    rounds = "".join(
        f""", s{i} AS (SELECT kind, host, sum(score) AS score FROM (
          SELECT kind, host, score * {1 - d} AS score FROM seeds UNION ALL
          SELECT e.kind, e.dst, p.score * e.weight * {d} FROM s{i - 1} p JOIN steps e ON p.kind = e.kind AND p.host = e.src) GROUP BY 1, 2)"""
        for i in range(1, urlrank.ITERATIONS + 1)
    )
    return rf"""
    WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
    b AS (SELECT page_id, html, t, regexp_extract(t, '^[^/?#]*') AS h FROM a),
    c AS (SELECT page_id, html, translate(h, '{urlrank.UPPER}', '{urlrank.LOWER}') AS host, regexp_extract(substr(t, length(h) + 1), '^[^?#]*') AS path FROM b),
    j AS (SELECT *, CASE {cases} END AS fit FROM c),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (fit LIKE 'allow %') AS good, count(*) FILTER (fit LIKE 'block %') AS bad FROM j WHERE host <> '' GROUP BY 1),
    seeds AS (SELECT 0 AS kind, host, good / n AS score FROM hosts WHERE good > 0 UNION ALL SELECT 1, host, bad / n FROM hosts WHERE bad > 0),
    l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1))) AS dst FROM j),
    links AS (SELECT src, translate(dst, '{urlrank.UPPER}', '{urlrank.LOWER}') AS dst, count(*) AS n FROM l WHERE src <> '' AND src <> translate(dst, '{urlrank.UPPER}', '{urlrank.LOWER}') GROUP BY 1, 2),
    both_ways AS (SELECT 0 AS kind, src, dst, n FROM links UNION ALL SELECT 1, dst, src, n FROM links),
    steps AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS weight FROM both_ways),
    s0 AS (SELECT kind, host, score * {1 - d} AS score FROM seeds){rounds},
    h AS (SELECT host, round(sum(CASE kind WHEN 0 THEN score ELSE 0 END) / {1 - d}, 9) AS trust, round(sum(CASE kind WHEN 1 THEN score ELSE 0 END) / {1 - d}, 9) AS distrust
          FROM s{urlrank.ITERATIONS} GROUP BY 1)
    SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
           CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) WHEN round(coalesce(distrust, 0) - coalesce(trust, 0), 9) >= {urlrank.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
    FROM j LEFT JOIN h USING (host)
    """


@query("op3_url_linkgraph", _url_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrank.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op4_warc_roundtrip",
    """
    WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS page FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page IS NULL OR page_id = page THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> page THEN page END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(read_table(spark, sf_dir, "pages"))


@query("op5_minimax_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


@query("op6_string_tiling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(
    "op7_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urlrank.UPPER}', '{urlrank.LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON b.x = r.other)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY 1) USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copy_components(read_table(spark, sf_dir, "documents"))


@query("op8_block_labeller")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract_pages(read_table(spark, sf_dir, "pages"))


@query("op9_conflict_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack_clusters(jaccard.sized_clusters(docs))


@query("op10_linked_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(read_table(spark, sf_dir, "documents"))


@query(
    "op11_skiplist_infill",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    k AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
                 CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
    c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS x, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS y,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, coalesce(array_to_string(tokens[1:x], ''), '') AS prefix, coalesce(array_to_string(tokens[x + 1:y], ''), '') AS middle, coalesce(array_to_string(tokens[y + 1:], ''), '') AS suffix FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(read_table(spark, sf_dir, "documents"))


@query("op12_determinant_outliers")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge_documents(read_table(spark, sf_dir, "documents"))


# CRC-32 of a decimal, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) for z in range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""


@query(
    "op13_lcp_trie",
    f"""
    WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'digest': digest, 'chars': chars}} ORDER BY turn NULLS FIRST, digest) AS turns FROM t GROUP BY 1),
    h AS (SELECT *, {_CRC32} % 6 AS h FROM own),
    r AS (SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
    e AS (SELECT conv_id, len(turns) AS size, d, array_to_string(list_transform(turns[1:d], lambda x: x.digest), '') AS key, coalesce(turns[d].chars, 0) AS chars FROM r, unnest(range(len(turns) + 1)) u(d)),
    g AS (SELECT d AS depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
    k AS (SELECT depth - 1 AS depth, key[1:32 * (depth - 1)] AS key, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1, 2),
    s AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (depth, key)),
    a AS (SELECT u.k AS depth, key[1:32 * u.k] AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM s, unnest(range(depth + 1)) u(k) GROUP BY 1, 2)
    SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
    FROM s JOIN a USING (depth, key) LEFT JOIN g p ON p.depth = s.depth - 1 AND p.key = s.key[1:32 * (s.depth - 1)]
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.build_trie(read_table(spark, sf_dir, "conversations"))
