"""Chunk generators and context expansion over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking, expansion, sparse
from corpusmill.plans import sqltext as Q
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import bm25_hits, with_texts
from corpusmill.session import read_table, spread

SPACE = r"[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}\x0b\x1c-\x1f]"
TOKEN = r"[㐀-鿿]|[A-Za-z]+(?:[''’][A-Za-z]+)?|\d+(?:[.,:/-]\d+)*|[^\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{1680}\x0b\x1c-\x1f]"


def trim_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean_sql(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{SPACE}+', ' ', 'g'))"


def dynamic_ctes(name: str, source: str, key: str, text: str, budget: int) -> str:
    """CTEs ending in ``{name}({key}, part, content)``: greedy sentence packing."""
    p = name
    return f"""
    {p}_p AS (SELECT {key}, pi, p FROM (SELECT {key}, unnest(string_split_regex({trim_sql(text)}, '\\n{SPACE}*\\n+')) AS p, unnest(range(1, len(string_split_regex({trim_sql(text)}, '\\n{SPACE}*\\n+')) + 1)) AS pi FROM {source})),
    {p}_q AS (SELECT {key}, pi, string_split(regexp_replace(regexp_replace({trim_sql('p')}, '([。！？!?；;]){SPACE}*', '\\1' || chr(1), 'g'), '([.!?]){SPACE}+([A-Z0-9㐀-鿿])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM {p}_p),
    {p}_s AS (SELECT {key}, pi, unnest(range(1, len(ss) + 1)) AS si, {clean_sql('unnest(ss)')} AS s FROM {p}_q),
    {p}_t AS (SELECT {key}, pi, si, s, regexp_extract_all(s, '{TOKEN}') AS tk FROM {p}_s WHERE s <> ''),
    {p}_e AS (SELECT {key}, pi, si, unnest(CASE WHEN len(tk) <= {budget} THEN [s] ELSE list_transform(range(0, len(tk), {budget}), lambda k: array_to_string(tk[k + 1:k + {budget}], '')) END) AS s,
              unnest(CASE WHEN len(tk) <= {budget} THEN [0] ELSE range(0, len(tk), {budget}) END) AS ki FROM {p}_t),
    {p}_n AS (SELECT {key}, s, len(regexp_extract_all(s, '{TOKEN}')) AS n, row_number() OVER (PARTITION BY {key} ORDER BY pi, si, ki) AS i FROM {p}_e),
    {p}_r AS (
      SELECT {key}, i, n AS used, 1 AS part FROM {p}_n WHERE i = 1
      UNION ALL
      SELECT x.{key}, x.i, CASE WHEN r.used >= {budget} OR r.used + x.n > {budget} THEN x.n ELSE r.used + x.n END,
             CASE WHEN r.used >= {budget} OR r.used + x.n > {budget} THEN r.part + 1 ELSE r.part END
      FROM {p}_r r JOIN {p}_n x ON x.{key} = r.{key} AND x.i = r.i + 1),
    {p} AS (SELECT {key}, part, string_agg(s, chr(10) ORDER BY i) AS content FROM {p}_r JOIN {p}_n USING ({key}, i) GROUP BY ALL)"""


def documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


@query(
    "hard_chunks",
    f"""WITH d AS (SELECT doc_id, {trim_sql('text')} AS t FROM documents),
        x AS (SELECT doc_id, t, unnest(range(0, length(t), 600)) AS o FROM d),
        y AS (SELECT doc_id, o, {trim_sql('substr(t, o + 1, 600)')} AS c FROM x)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS part, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS content_md5 FROM y WHERE c <> ''""",
)
def hard_chunks(spark, sf_dir):
    cut = chunking.chunk(documents(spark, sf_dir).select("doc_id", "text"), "text", 600, strategy="hard")
    return cut.select(
        "doc_id", F.col("part").cast("long").alias("part"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query(
    "hard_chunk_spans",
    f"""WITH d AS (SELECT doc_id, {trim_sql('text')} AS t, length(text) - length(regexp_replace(text, '^{SPACE}+', '')) AS lead FROM documents),
        x AS (SELECT doc_id, t, lead, unnest(range(0, length(t), 600)) AS o FROM d)
        SELECT doc_id, o // 600 + 1 AS chunk_index, lead + o AS start_char, lead + least(length(t), o + 600) AS end_char, md5({trim_sql('substr(t, o + 1, 600)')}) AS content_md5
        FROM x WHERE {trim_sql('substr(t, o + 1, 600)')} <> ''""",
)
def hard_chunk_spans(spark, sf_dir):
    cut = chunking.hard_chunks_with_spans(documents(spark, sf_dir), "doc_id", "text")
    return cut.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")], F.md5("content").alias("content_md5")
    )


@query(
    "token_windows",
    f"""WITH d AS (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents),
        x AS (SELECT doc_id, toks, unnest(CASE WHEN len(toks) = 0 THEN [0] ELSE range(0, len(toks), 30) END) AS start FROM d)
        SELECT doc_id, start, CAST(len(toks[start + 1:start + 40]) AS BIGINT) AS n_tokens, md5(array_to_string(toks[start + 1:start + 40], ' ')) AS window_md5 FROM x""",
)
def token_windows(spark, sf_dir):
    from corpusmill.functions.text import bm25_tokens

    toks = documents(spark, sf_dir).select("doc_id", bm25_tokens("text").alias("toks"))
    rows = toks.select("doc_id", F.explode_outer(chunking.token_windows(F.col("toks"), 40, 10)).alias("w"))
    return rows.select(
        "doc_id",
        F.col("w.start").cast("long").alias("start"),
        F.size("w.tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("w.tokens", " ")).alias("window_md5"),
    )


@query(
    "sentence_units",
    rf"""WITH p AS (SELECT doc_id, unnest(string_split_regex({trim_sql('text')}, '\n{SPACE}*\n+')) AS p FROM documents),
        q AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({trim_sql('p')}, '([。！？!?；;]){SPACE}*', '\1' || chr(1), 'g'), '([.!?]){SPACE}+([A-Z0-9㐀-鿿])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM p),
        s AS (SELECT doc_id, {clean_sql('unnest(ss)')} AS s FROM q)
        SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s WHERE s <> '' GROUP BY doc_id""",
)
def sentence_units(spark, sf_dir):
    from corpusmill.functions.text import sentence_units as units

    rows = documents(spark, sf_dir).select("doc_id", units("text").alias("u")).filter(F.size("u") > 0)
    return rows.select(
        "doc_id",
        F.size("u").cast("long").alias("n_sentences"),
        F.array_max(F.transform("u", F.length)).cast("long").alias("longest"),
        F.aggregate("u", F.lit(0), lambda a, s: a + F.length(s)).cast("long").alias("n_chars"),
    )


@query(
    "dynamic_chunks",
    f"""WITH RECURSIVE {dynamic_ctes('dyn', 'documents', 'doc_id', 'text', 128)}
        SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM dyn""",
)
def dynamic_chunks(spark, sf_dir):
    """Sentence packing without overlap."""
    cut = chunking.chunk(documents(spark, sf_dir).select("doc_id", "text"), "text", 128, strategy="dynamic", overlap_tokens=0)
    return cut.select(
        "doc_id", F.col("part").cast("long").alias("part"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query("dynamic_chunks_overlap")
def dynamic_chunks_overlap(spark, sf_dir):
    """Default flat chunking: 600 tokens, trailing sentences carried up to 200 tokens."""
    cut = chunking.chunk(documents(spark, sf_dir).select("doc_id", "text"), "text", 600, strategy="dynamic", overlap_tokens=200)
    return cut.select("doc_id", "part", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("boundary_chunks")
def boundary_chunks(spark, sf_dir):
    """Character windows pulled back to a boundary; every window start depends on the last."""
    cut = chunking.chunk(documents(spark, sf_dir).select("doc_id", "text"), "text", 600, stride=450, strategy="boundary")
    return cut.select("doc_id", "part", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def units(spark, sf_dir):
    """Every document as one extraction unit of its own file."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.col("source"), F.lit(".txt")).alias("filename"),
        F.lit(1).alias("unit_index"),
        F.col("lang").alias("title"),
        F.lit("").alias("page"),
        F.col("text").alias("content"),
    )


PARENT_CHILD_SQL = f"""
    cl AS (SELECT doc_id, source, lang, {clean_sql('text')} AS body FROM documents),
    {dynamic_ctes('par', 'cl', 'doc_id', 'body', 256)},
    pk AS (SELECT doc_id * 1000000 + part AS pid, doc_id, part AS parent_index, content FROM par),
    {dynamic_ctes('chi', 'pk', 'pid', 'content', 64)}"""


@query(
    "parent_child",
    f"""WITH RECURSIVE {PARENT_CHILD_SQL}
        SELECT doc_id || '::child::1-' || parent_index || '-' || c.part AS child_id, doc_id || '::parent::1-' || parent_index AS parent_id,
          CAST(len(regexp_extract_all(c.content, '{TOKEN}')) AS BIGINT) AS token_count, CAST(len(regexp_extract_all(pk.content, '{TOKEN}')) AS BIGINT) AS parent_token_count, md5(c.content) AS content_md5
        FROM chi c JOIN pk USING (pid)""",
)
def parent_child(spark, sf_dir):
    """Parents of 256 and children of 64 tokens (the test corpus has short texts)."""
    _, children = chunking.parent_child(units(spark, sf_dir), 256, 64)
    return children.select(
        "child_id",
        "parent_id",
        F.col("token_count").cast("long").alias("token_count"),
        F.col("parent_token_count").cast("long").alias("parent_token_count"),
        F.md5("content").alias("content_md5"),
    )


@query(
    "parent_chunks",
    f"""WITH RECURSIVE {PARENT_CHILD_SQL},
        c AS (SELECT doc_id, count(*) AS parts FROM pk GROUP BY doc_id)
        SELECT pk.doc_id || '::parent::1-' || parent_index AS parent_id, source || '.txt | ' || lang || CASE WHEN parts > 1 THEN ' / parent ' || parent_index ELSE '' END AS title,
          CAST(len(regexp_extract_all(content, '{TOKEN}')) AS BIGINT) AS token_count FROM pk JOIN c USING (doc_id) JOIN cl USING (doc_id)""",
)
def parent_chunks(spark, sf_dir):
    parents, _ = chunking.parent_child(units(spark, sf_dir), 256, 64)
    return parents.select("parent_id", "title", F.col("token_count").cast("long").alias("token_count"))


SECTION_TEXT = r"regexp_replace(text, '(?m)^([A-Z][a-z]+)', '### \1\n\1')"


@query(
    "markdown_sections",
    rf"""WITH d AS (SELECT doc_id, '## ' || source || chr(10) || regexp_replace(text, '(?m)^([A-Z][a-z]+)', '### \1' || chr(10) || '\1', 'g') AS md FROM documents),
        l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM d),
        g AS (SELECT *, CASE WHEN starts_with(line, '## ') OR starts_with(line, '### ') THEN 1 ELSE 0 END AS h FROM l),
        s AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM g),
        b AS (SELECT doc_id, sec, {trim_sql("string_agg(CASE WHEN h = 0 THEN line END, chr(10) ORDER BY i)")} AS content, min(CASE WHEN h = 1 THEN line END) AS heading, min(CASE WHEN h = 1 THEN i END) AS line_no, count(*) AS n FROM s WHERE sec > 0 GROUP BY ALL)
        SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, source AS parent_title, {trim_sql('substr(heading, 5)')} AS title, md5(content) AS content_md5
        FROM b JOIN documents USING (doc_id) WHERE starts_with(heading, '### ') AND n > 1 AND content <> ''""",
)
def markdown_sections(spark, sf_dir):
    """Sections of a markdown rendering of every document (capitalised line starts become headings)."""
    marked = F.concat(
        F.lit("## "), F.col("source"), F.lit("\n"), F.regexp_replace("text", r"(?m)^([A-Z][a-z]+)", "### $1\n$1")
    )
    sections = chunking.markdown_sections(documents(spark, sf_dir).select("doc_id", marked.alias("md")), "doc_id", "md")
    return sections.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "parent_title", "title", F.md5("content").alias("content_md5")
    )


@query(
    "parent_expand_dedupe",
    f"""WITH RECURSIVE {PARENT_CHILD_SQL},
        ch AS (SELECT row_number() OVER (ORDER BY doc_id, parent_index, c.part) AS chunk_id, doc_id || '::parent::1-' || parent_index AS parent_id, c.content FROM chi c JOIN pk USING (pid)),
        tf AS (SELECT chunk_id, parent_id, term, count(*) AS tf FROM (SELECT chunk_id, parent_id, unnest({Q.tokens('content')}) AS term FROM ch) GROUP BY ALL),
        dl AS (SELECT chunk_id, greatest(len({Q.tokens('content')}), 1) AS dl FROM ch),
        st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({Q.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
        sc AS (SELECT query_id, chunk_id, parent_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (0.28 + 0.72 * dl / a)) * (1 + ln(qf))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id) CROSS JOIN st GROUP BY ALL),
        rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 20),
        fs AS (SELECT query_id, parent_id, min(rank) AS child_rank FROM rk GROUP BY ALL)
        SELECT * FROM (SELECT query_id, parent_id AS context_id, child_rank, row_number() OVER (PARTITION BY query_id ORDER BY child_rank) AS context_rank FROM fs) WHERE context_rank <= 5""",
)
def parent_expand_dedupe(spark, sf_dir):
    """Search children, answer with their distinct parents."""
    parents, children = chunking.parent_child(units(spark, sf_dir), 256, 64, reuse=True)
    # Position of a child in its corpus: document, parent, child.
    numbered = children.withColumn(
        "ordinal",
        F.struct(F.col("source_id").cast("long").alias("d"), F.col("parent_index").alias("p"), F.col("child_index").alias("c")),
    )
    ix = sparse.build_index(numbered, "content", chunk_id="child_id", ordinal="ordinal")
    asked = read_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    hits = sparse.bm25_search(asked, ix, 20)
    selected = hits.withColumnRenamed("chunk_id", "child_id").withColumn(
        "parent_id", F.regexp_replace(F.regexp_replace("child_id", "::child::", "::parent::"), r"-\d+$", "")
    ).withColumn("content", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string"))
    out = expansion.expand_parents(selected, parents, limit=5)
    return out.select(
        "query_id", "context_id", F.col("rank").cast("long").alias("child_rank"), F.col("context_rank").cast("long").alias("context_rank")
    )


PIECES_SQL = f"""
    hd AS (SELECT doc_id AS d, {trim_sql('text')} AS t FROM documents),
    hx AS (SELECT d, t, unnest(range(0, length(t), 600)) AS o FROM hd),
    pc AS (SELECT d * 10000 + o // 600 + 1 AS doc_id, d, o // 600 + 1 AS part, {trim_sql('substr(t, o + 1, 600)')} AS text, '' AS source FROM hx WHERE {trim_sql('substr(t, o + 1, 600)')} <> '')"""


def pieces(spark, sf_dir):
    """600-character chunks of all documents; the id keeps document and position order."""
    cut = chunking.hard_chunks_with_spans(documents(spark, sf_dir), "doc_id", "text")
    return cut.withColumn("chunk_id", F.col("doc_id") * 10000 + F.col("chunk_index"))


@query(
    "neighbor_expand",
    f"""WITH {PIECES_SQL}, {Q.bm25_ctes(5, corpus='SELECT doc_id, source, text FROM pc')},
        h AS (SELECT query_id, bm.rank, p.d, p.part AS hit FROM bm JOIN pc p ON p.doc_id = bm.chunk_id),
        nb AS (SELECT query_id, rank, c.doc_id, c.part, abs(c.part - hit) AS distance FROM h JOIN pc c ON c.d = h.d AND abs(c.part - hit) <= 1),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, distance, part) AS n FROM nb) WHERE n = 1)
        SELECT query_id, doc_id AS chunk_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, distance, part) AS position FROM f) WHERE position <= 8""",
)
def neighbor_expand(spark, sf_dir):
    """Chunk search, then the chunks before and after every hit."""
    cut = pieces(spark, sf_dir)
    ix = sparse.build_index(cut, "content")
    asked = read_table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    placed = cut.select("chunk_id", F.col("doc_id").alias("section_id"), "chunk_index")
    hits = sparse.bm25_search(asked, ix, 5).select(
        "query_id",
        "rank",
        F.floor(F.col("chunk_id") / 10000).cast("long").alias("section_id"),
        F.pmod(F.col("chunk_id"), F.lit(10000)).cast("int").alias("chunk_index"),
    )
    out = expansion.neighbor_expand(hits, placed)
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


@query(
    "best_parent_window",
    f"""WITH {Q.bm25_ctes(10)},
        t AS (SELECT query_id, chunk_id, regexp_extract_all(d.text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w, list_transform(regexp_extract_all(b.text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: lower(x)) AS q FROM bm JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id),
        x AS (SELECT query_id, chunk_id, q, w[o + 1:o + 200] AS win, o // 200 AS i FROM (SELECT *, unnest(range(0, len(w), 200)) AS o FROM t)),
        y AS (SELECT query_id, chunk_id, i, len(list_filter(win, lambda z: list_contains(q, lower(z)))) AS hits, len(win) AS n FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY hits DESC, i) AS r, count(*) OVER (PARTITION BY query_id, chunk_id) AS parents FROM y)
        SELECT query_id, chunk_id, parents AS parent_chunk_count, i AS parent_chunk_index, n AS parent_token_count, hits AS term_hits FROM z WHERE r = 1""",
)
def best_parent_window(spark, sf_dir):
    hits = with_texts(bm25_hits(spark, sf_dir, 10).select("query_id", "chunk_id"), spark, sf_dir)
    out = chunking.best_parent_window(hits)
    return out.select(
        "query_id", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ("parent_chunk_count", "parent_chunk_index", "parent_token_count", "term_hits")]
    )


@query(
    "sentence_pairs",
    rf"""WITH s AS (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, {clean_sql('unnest(ss)')} AS s FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace({clean_sql('text')}, '([。！？!?；;]){SPACE}*', '\1' || chr(1), 'g'), '([.!?]){SPACE}+([A-Z0-9㐀-鿿])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM documents)),
        k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM s WHERE s <> ''),
        p AS (SELECT doc_id, i, s, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM k),
        u AS (SELECT doc_id, false AS is_pair, s AS c FROM p UNION ALL SELECT doc_id, true, trim(s || ' ' || nx) FROM p WHERE nx IS NOT NULL AND length(trim(s || ' ' || nx)) <= 480)
        SELECT doc_id, is_pair, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM u WHERE length(c) >= 8 GROUP BY ALL""",
)
def sentence_pairs(spark, sf_dir):
    from corpusmill.functions.text import clean_spaces
    from corpusmill.functions.text import sentence_units as split

    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(split(clean_spaces(F.col("text")))).alias("i", "sentence"))
    out = expansion.sentence_pairs(rows, ("doc_id",), "i", "sentence")
    return out.groupBy("doc_id", "is_pair").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))
