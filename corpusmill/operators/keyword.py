"""Keyword scoring of short texts against whole chunks, and the hybrid on top.

The score adds 3 per exact token, 1 per token that only occurs as a substring
and n per shared character n-gram (4, 3, 2; repeats count). Nearly every chunk
shares some bigram with a question, so the pairs are scored like the dense
search: the measured question side is broadcast as a gram-by-question matrix,
each chunk adds the rows of its grams, and a task keeps its own best k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions.text import char_ngrams, compact, find_all, keyword_tokens, let, multi_ngrams, text_of
from corpusmill.operators.dense import _best, _hit_schema, _ids, _merge_best
from corpusmill.operators.expansion import preserve_anchors
from corpusmill.operators.sparse import top_k
from corpusmill.session import BROADCAST_LIMIT_BYTES, fits_broadcast, salted_join, spread

GRAM_SIZES = (4, 3, 2)
MATRIX_LIMIT_BYTES = 4 * BROADCAST_LIMIT_BYTES
# What Spark takes for white space; Python's own set is larger.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_TOKENS = re.compile(r"[A-Za-z0-9_,.]+")
_CJK = re.compile(r"[一-鿿]{2,}")


def dense_text(column: Column) -> Column:
    """Text without white space, case kept."""
    return F.regexp_replace(text_of(column), r"(?U)\s+", "")


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int, query_text: str = "text", chunk_text: str = "content", boost: DataFrame | None = None) -> DataFrame:
    """Best ``k`` chunks per query: ``query_id, chunk_id, score, rank``.

    ``boost(query_id, chunk_id, boost)`` adds metadata points to scored pairs.
    """
    grams = queries.select("query_id", F.explode(multi_ngrams(dense_text(F.col(query_text)), GRAM_SIZES)).alias("key")).groupBy("query_id", "key").agg(
        F.sum(F.length("key")).alias("points")
    )
    tokens = queries.select("query_id", F.explode(keyword_tokens(query_text)).alias("key")).groupBy("query_id", "key").agg(F.count("*").alias("times"))
    if boost is None and fits_broadcast(grams) and _matrix_bytes(grams, queries) <= MATRIX_LIMIT_BYTES:
        scored = _matrix_search(grams, tokens, chunks.select("chunk_id", F.col(chunk_text).alias("content")), k)
    else:
        scored = _join_search(grams, tokens, chunks.select("chunk_id", F.col(chunk_text).alias("content")))
        if boost is not None:
            scored = scored.join(boost, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0))).drop("boost")
    return top_k(scored.filter("score > 0"), ("query_id",), k, "score", "chunk_id")


def _matrix_bytes(grams: DataFrame, queries: DataFrame) -> int:
    """Size of the dense gram-by-question matrix, known before it is built."""
    return 4 * queries.count() * grams.select("key").distinct().count()


def _matrix_search(grams: DataFrame, tokens: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    # Bounded by the measurement in keyword_search; tokens are fewer than grams.
    g, t = grams.toPandas(), tokens.toPandas()
    schema = _hit_schema(grams, chunks)
    ids = np.array(sorted(set(g["query_id"]) | set(t["query_id"])))
    if len(ids) == 0:
        return chunks.sparkSession.createDataFrame([], schema)
    column = {q: i for i, q in enumerate(ids.tolist())}

    def table(frame: pd.DataFrame, value: str):
        keys = {key: i for i, key in enumerate(frame["key"].unique())}
        weights = np.zeros((len(keys), len(ids)), dtype=np.float32)
        for q, key, v in zip(frame["query_id"], frame["key"], frame[value]):
            weights[keys[key], column[q]] += v
        return keys, weights

    shared = chunks.sparkSession.sparkContext.broadcast((ids, table(g, "points"), table(t, "times")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, (gram_row, gram_points), (token_row, token_times) = shared.value
        tree = _Substrings([*gram_row, *token_row])
        best = None
        for frame in batches:
            texts = frame["content"].fillna("").tolist()
            bodies = [_SPACE.sub("", text) for text in texts]
            ids_here = _ids(pa.array(frame["chunk_id"]))
            for low, high in _cuts([len(b) for b in bodies], max(1, CELLS_AT_ONCE // tree.size)):
                have = tree.found(bodies[low:high])
                scores = have[:, : len(gram_row)].astype(np.float32) @ gram_points
                loose = have[:, len(gram_row) :].astype(np.float32)
                for i, text in enumerate(texts[low:high]):
                    exact = [token_row[x] for x in {x.lower() for x in _TOKENS.findall(text)} | set(_CJK.findall(text)) if x in token_row]
                    loose[i, exact] = 3
                scores = (scores + loose @ token_times).T.astype(np.float64)
                q, c, s = _best(query_ids, ids_here[low:high], scores, k)
                hits = pd.DataFrame({"query_id": q, "chunk_id": c, "score": s})
                best = hits if best is None else _merge_best(pd.concat([best, hits]), k)
        if best is not None:
            yield best

    return spread(chunks, "chunk_id").mapInPandas(score, schema)


# Cells of a presence table, and characters of texts, that a task handles at once.
CELLS_AT_ONCE = 16_000_000
CHARS_AT_ONCE = 1_000_000
# Cells up to which the children of the tree are looked up in a plain table.
TABLE_CELLS = 32_000_000


def _cuts(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded number and length; a longer text is a run of its own."""
    low = total = 0
    for i, n in enumerate(lengths):
        if i > low and (i - low >= most or total + n > CHARS_AT_ONCE):
            yield low, i
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


class _Substrings:
    """Which of given strings occur in texts: a prefix tree walked from all positions at once."""

    def __init__(self, strings: list[str]):
        letters = sorted({c for s in strings for c in s})
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, dtype=np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.wide = len(letters) + 1
        number = {c: i + 1 for i, c in enumerate(letters)}
        children: dict[tuple[int, int], int] = {}
        self.ends = np.zeros(len(strings), dtype=np.int64)
        for row, s in enumerate(strings):
            node = 0
            for c in s:
                node = children.setdefault((node, number[c]), len(children) + 1)
            self.ends[row] = node
        self.size = len(children) + 1
        keys = np.array([n * self.wide + c for n, c in children], dtype=np.int64)
        nodes = np.fromiter(children.values(), dtype=np.int64, count=len(children))
        self.inner = np.zeros(self.size, dtype=bool)
        self.inner[keys // self.wide] = True
        self.table = None
        if self.size * self.wide <= TABLE_CELLS:
            self.table = np.zeros(self.size * self.wide, dtype=np.int32)
            self.table[keys] = nodes
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def _child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = node * self.wide + letter
        if self.table is not None:
            return self.table[key]
        if not len(self.keys):
            return np.zeros(len(key), dtype=np.int64)
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], 0)

    def found(self, texts: list[str]) -> np.ndarray:
        """Texts x strings."""
        # A sign that no string has ends every text, and so does the end of all.
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = self.letter[np.minimum(codes, len(self.letter) - 1)]
        row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        letters[np.cumsum([len(t) + 1 for t in texts]) - 1] = 0
        have = np.zeros((len(texts), self.size), dtype=bool)
        have[:, 0] = True
        at = np.flatnonzero(letters)
        node = np.zeros(len(at), dtype=np.int64)
        start = at
        while len(at):
            node = self._child(node, letters[at])
            live = node > 0
            at, start, node = at[live], start[live], node[live]
            have[row[start], node] = True
            more = self.inner[node]
            at, start, node = at[more] + 1, start[more], node[more]
        return have[:, self.ends]


def _join_search(grams: DataFrame, tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same score through joins, for question sets too large to broadcast."""
    rows = spread(chunks, "chunk_id").withColumn("_d", dense_text(F.col("content")))
    keys = rows.select("chunk_id", F.explode(F.array_distinct(multi_ngrams(F.col("_d"), GRAM_SIZES))).alias("key"))
    by_gram = salted_join(keys, grams, on="key", salt_by="chunk_id").groupBy("query_id", "chunk_id").agg(F.sum("points").alias("points"))
    own = rows.select("chunk_id", F.explode(F.array_distinct(keyword_tokens("content"))).alias("key"))
    exact = salted_join(own, tokens, on="key", salt_by="chunk_id").select("query_id", "chunk_id", "key", "times")
    # A token inside a chunk is there with its first (at most four) characters.
    lead = tokens.withColumn("start", F.substring("key", 1, 4))
    starts = rows.select("chunk_id", F.explode(F.array_distinct(F.concat(char_ngrams(F.col("_d"), 1), multi_ngrams(F.col("_d"), GRAM_SIZES)))).alias("start"))
    near = salted_join(starts, lead, on="start", salt_by="chunk_id").join(rows.select("chunk_id", "_d"), "chunk_id").filter(F.contains("_d", F.col("key")))
    loose = near.select("query_id", "chunk_id", "key", "times").join(exact.select("query_id", "chunk_id", "key"), ["query_id", "chunk_id", "key"], "left_anti")
    parts = (
        by_gram.unionByName(exact.select("query_id", "chunk_id", (3 * F.col("times")).alias("points")))
        .unionByName(loose.select("query_id", "chunk_id", F.col("times").alias("points")))
    )
    return parts.groupBy("query_id", "chunk_id").agg(F.sum("points").cast("double").alias("score"))


def metadata_points(query: Column, title: Column) -> Column:
    """Points for tokens (twice their length, at most 16) and n-grams (6 to 2) of the query in a title."""
    words = F.filter(keyword_tokens(query), lambda t: F.length(t) >= 2)
    token_points = F.aggregate(
        words, F.lit(0), lambda acc, t: acc + F.when(F.contains(title, t), F.least(F.length(t) * 2, F.lit(16))).otherwise(0)
    )
    gram_points = let(
        dense_text(title),
        lambda dense: F.aggregate(
            multi_ngrams(dense_text(query), (6, 5, 4, 3, 2)),
            F.lit(0),
            lambda acc, g: acc + F.when(F.contains(dense, g), F.length(g)).otherwise(0),
        ),
    )
    return token_points + gram_points


# Questions about the opening of a document.
OPENING_TERMS = ("開頭", "文件開頭", "一開始", "最前面", "metadata", "標題", "作者署名")
PROLOGUE = "楔子"
OUTCOME_FIELDS = "結果|狀態|判定|結論|任務|事件|流程|步驟|階段|案件|處理狀態|task|event|process|step|case|status|result|outcome"


def position_points(query: Column, title: Column, chunk_index: Column) -> Column:
    """Opening questions favour the first chunks, prologue questions the prologue."""
    q, t = dense_text(query), dense_text(title)
    opening = F.lit(False)
    for term in OPENING_TERMS:
        opening = opening | F.contains(q, F.lit(term))
    prologue = F.contains(q, F.lit(PROLOGUE))
    first = F.when((chunk_index == 0) | F.contains(t, F.lit("文件開頭")), 80).when(chunk_index <= 2, 30).otherwise(0)
    intro = F.when(F.contains(t, F.lit(PROLOGUE)), 80).when(chunk_index <= 3, 20).otherwise(0)
    return F.when(prologue, intro).when(opening, first).otherwise(0)


def polarity_points(query: Column, text: Column) -> Column:
    """Outcome questions: the outcome as a field value +28, a mention +6, negated -24."""
    q, body = dense_text(query), dense_text(text)
    negated = {"失敗": r"失敗\w{0,4}0|0失敗|無失敗|沒有失敗", "成功": r"未成功|沒有成功|不成功|成功\w{0,4}0"}
    total = F.lit(0)
    for word, pattern in negated.items():
        points = (
            F.when(body.rlike(f"({OUTCOME_FIELDS})[:：]{word}"), 28).when(F.contains(body, F.lit(word)), 6).otherwise(0)
            - F.when(body.rlike(f"(?U){pattern}"), 24).otherwise(0)
        )
        total = total + F.when(F.contains(q, F.lit(word)), points).otherwise(0)
    return total


def hybrid_search(
    keyword: DataFrame,
    near: DataFrame,
    metadata: DataFrame,
    k: int,
    keyword_weight: float = 0.6,
    embedding_weight: float = 0.4,
    metadata_boost_max: float = 0.18,
    rrf_k: int = 60,
) -> DataFrame:
    """Rank fusion plus a capped metadata boost, strong keyword hits kept.

    ``keyword`` and ``near`` are ranked lists; ``metadata(query_id, chunk_id,
    points)`` adds ``min(points / 100, cap)``, which outweighs the rank scores.
    """
    left = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    right = near.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer").join(metadata, ["query_id", "chunk_id"], "full_outer")
    score = (
        F.coalesce(F.lit(keyword_weight) / (rrf_k + F.col("keyword_rank")), F.lit(0.0))
        + F.coalesce(F.lit(embedding_weight) / (rrf_k + F.col("dense_rank")), F.lit(0.0))
        + F.least(F.coalesce(F.col("points"), F.lit(0)) * 0.01, F.lit(metadata_boost_max))
    )
    scored = joined.withColumn("score", score).filter("score > 0")
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank")
    return preserve_anchors(ranked, left.select("query_id", "chunk_id", "keyword_score", "keyword_rank"), k)


# Definition markers by weight (naming, identity, concrete, other).
DEFINITION_MARKERS = {
    **dict.fromkeys(("正式稱呼", "正式称呼", "稱呼", "称呼", "又稱", "又称", "稱為", "称为", "被稱為", "被称为", "叫它", "叫做", "叫作", "指的是"), 10),
    **dict.fromkeys(("定義", "定义", "身份", "角色"), 8),
    **dict.fromkeys(("功能", "用途", "材料", "構成", "构成", "形狀", "形状"), 4),
    **dict.fromkeys(("代表", "意思", "作用", "來源", "来源"), 1),
}


def definition_search(subjects: DataFrame, chunks: DataFrame, k: int, max_distance: int = 90) -> DataFrame:
    """Chunks with a definition marker near the subject: 8 + marker weights + min(6, mentions).

    ``subjects(query_id, subject)``; chunks meet subjects by containment.
    """
    from corpusmill.operators.matching import contains_pairs

    rows = chunks.select("chunk_id", compact(F.concat_ws(" ", text_of("parent_title"), text_of("title"), text_of("content"))).alias("body"))
    terms = subjects.select("query_id", compact(F.col("subject")).alias("subject"))
    pairs = contains_pairs(rows, terms, "chunk_id", "body", "query_id", "subject").join(rows, "chunk_id").join(terms, "query_id")
    quoted = F.regexp_replace("subject", r"([\\\[\](){}.*+?^$|])", r"\\$1")
    weight = F.lit(0)
    for marker, points in DEFINITION_MARKERS.items():
        # Distance is between the first characters of subject and marker.
        gap_after = F.greatest(F.lit(0), F.lit(max_distance) - F.length("subject"))
        gap_before = max(0, max_distance - len(marker))
        near = F.concat(
            F.lit("(?s)"), quoted, F.lit(".{0,"), gap_after.cast("string"), F.lit("}"), F.lit(marker), F.lit("|"), F.lit(marker),
            F.lit(f".{{0,{gap_before}}}"), quoted,
        )
        weight = weight + F.when(F.regexp("body", near), points).otherwise(0)
    mentions = F.size(F.split("body", quoted, -1)) - 1
    scored = pairs.withColumn("weight", weight).filter("weight > 0").withColumn(
        "score", (F.lit(8) + F.col("weight") + F.least(F.lit(6), mentions)).cast("double")
    )
    return top_k(scored.select("query_id", "chunk_id", "weight", "score"), ("query_id",), k, "score", "chunk_id")


def definition_subject(question: Column) -> Column:
    """Subject of a what-is question, or an empty string."""
    text = F.regexp_replace(F.trim(F.regexp_replace(text_of(question), r"(?U)\s+", " ")), r"^[請请]\s*問\s*", "")
    text = F.regexp_replace(text, r"^[ 　\t\r\n？?。.!！]+|[ 　\t\r\n？?。.!！]+$", "")
    patterns = (
        r"^(.{1,32}?)(?:是|為|为)(?:什麼|什么|誰|谁)(?:東西|东西|人|角色|概念|意思|內容|内容)?$",
        r"^(.{1,32}?)(?:指的是|代表的是|代表|意味著|意味着)(?:什麼|什么)?$",
        r"^(?:何謂|何谓|什麼是|什么是)(.{1,32}?)$",
    )
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns], F.lit(""))
    return F.when(text.rlike("為什麼|为什么|爲什麼|如何|怎麼|怎么|何時|何时|哪裡|哪里"), "").otherwise(F.trim(found))


def diversify(results: DataFrame, anchors: DataFrame, candidates: DataFrame, limit: int = 6) -> DataFrame:
    """Add the first unused hit of each anchor, at most ``limit`` per query.

    ``anchors(query_id, anchor_no)``, ``candidates(query_id, anchor_no, chunk_id,
    rank)`` are the five best keyword hits of an anchor, so a group is small.
    """
    used = results.select("query_id", "chunk_id").withColumn("_u", F.lit(True))
    rows = candidates.join(anchors, ["query_id", "anchor_no"], "left_semi").join(used, ["query_id", "chunk_id"], "left").filter("_u IS NULL").drop("_u")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, group in frame.sort_values(["anchor_no", "rank"]).groupby("anchor_no", sort=True):
            for row in group.itertuples():
                if row.chunk_id not in taken:
                    taken.add(row.chunk_id)
                    out.append((row.query_id, row.chunk_id, len(out) + 1))
                    break
            if len(out) >= limit:
                break
        return pd.DataFrame(out, columns=["query_id", "chunk_id", "extra_rank"])

    types = dict(rows.dtypes)
    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, extra_rank int")


def question_words(question: Column) -> Column:
    return find_all(question, r"[A-Za-z0-9_.+-]+|[\x{4e00}-\x{9fff}]{2,}")
