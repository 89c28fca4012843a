"""Exact dense search.

The query vectors are the small side: measured, broadcast, and multiplied
against Arrow batches of the corpus. Every task keeps only its own best k per
query, so what is shuffled is ``k x tasks`` rows per query. A query side above
the limit is cut into blocks and corpus rows into cells; each cell meets each
query block once (a grid), and the same per-cell top k applies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.sparse import RANK_DIGITS, top_k
from corpusmill.session import broadcast_checked, fits_broadcast, spread

ROWS_PER_CELL = 100_000
QUERIES_PER_BLOCK = 20_000
# Questions and corpus rows multiplied at once: bounds the score block of a task.
QUERIES_AT_ONCE = 256
ROWS_AT_ONCE = 2048


def _id_type(df: DataFrame, name: str) -> str:
    return "long" if isinstance(df.schema[name].dataType, T.IntegralType) else "string"


def _ids(values: pa.Array) -> np.ndarray:
    """Ids as an array that sorts like Spark sorts them."""
    return values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) else np.array(values.to_pylist(), dtype=str)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0.0] = 1.0
    return matrix / norms


def _best(query_ids, ids, scores, k):
    """Best ``k`` rows per query of a score block (queries x chunks)."""
    falling = -np.round(scores, RANK_DIGITS)
    out_q, out_c, out_s = [], [], []
    # Only rows at least as good as the k-th best are ordered; ties at the edge stay in.
    edge = np.partition(falling, k - 1, axis=1)[:, k - 1] if falling.shape[1] > k else None
    for row in range(scores.shape[0]):
        near = np.arange(falling.shape[1]) if edge is None else np.flatnonzero(falling[row] <= edge[row])
        order = near[np.lexsort((ids[near], falling[row][near]))[:k]]
        out_q.append(np.full(len(order), query_ids[row]))
        out_c.append(ids[order])
        out_s.append(scores[row][order])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _reaching(query_ids, ids, scores, k, least):
    """As ``_best``, among the scores that reach ``least``, the k-th best of each query so far."""
    near = ~(scores < least[:, None] - 2 * 10.0**-RANK_DIGITS)
    if np.count_nonzero(near) > 4 * k * len(query_ids):  # many ties, or no k rows so far
        return _best(query_ids, ids, scores, k)
    row, at = np.nonzero(near)
    found = scores[row, at]
    order = np.lexsort((ids[at], -np.round(found, RANK_DIGITS), row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return query_ids[row[first]], ids[at[order[first]]], found[order[first]]


def _merge_best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.assign(r=frame["score"].round(RANK_DIGITS))
    frame = frame.sort_values(["query_id", "r", "chunk_id"], ascending=[True, False, True])
    return frame.groupby("query_id", sort=False).head(k).drop(columns="r")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def dense_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    allowed: DataFrame | None = None,
    vector: str = "embedding",
) -> DataFrame:
    """Cosine top ``k``: ``query_id, chunk_id, score, rank`` (ties to the lower id).

    ``queries(query_id, embedding)``, ``chunks(chunk_id, embedding[, source_id])``;
    ``allowed(source_id)`` restricts the candidate rows before scoring.
    """
    corpus = chunks.filter(F.col(vector).isNotNull())
    if allowed is not None:
        corpus = corpus.join(allowed.select("source_id").distinct(), "source_id", "left_semi")
    corpus = corpus.select(F.col("chunk_id").cast(_id_type(corpus, "chunk_id")).alias("chunk_id"), F.col(vector).alias("embedding"))
    wanted = queries.select(F.col("query_id").cast(_id_type(queries, "query_id")).alias("query_id"), F.col(vector).alias("embedding"))
    if fits_broadcast(wanted):
        hits = _broadcast_search(wanted, corpus, k)
    else:
        hits = _grid_search(wanted, corpus, k)
    return top_k(hits, ("query_id",), k, "score", "chunk_id")


def _hit_schema(wanted: DataFrame, corpus: DataFrame) -> str:
    return f"query_id {_id_type(wanted, 'query_id')}, chunk_id {_id_type(corpus, 'chunk_id')}, score double"


def _least(query_ids, best: pd.DataFrame, k: int) -> np.ndarray:
    """The k-th best score of each query; what is missing or no number is reached by all."""
    kth = best["score"].round(RANK_DIGITS).groupby(best["query_id"]).agg(["count", "min"]).reindex(query_ids)
    return np.where(kth["count"] >= k, kth["min"], -np.inf)


def _block_best(query_ids, query_matrix, ids, block, k, least=None):
    """Best ``k`` rows of a block per query, a bounded number of queries at a time."""
    parts = [slice(a, a + QUERIES_AT_ONCE) for a in range(0, len(query_ids), QUERIES_AT_ONCE)]
    if least is None:
        found = [_best(query_ids[p], ids, query_matrix[p] @ block.T, k) for p in parts]
    else:
        found = [_reaching(query_ids[p], ids, query_matrix[p] @ block.T, k, least[p]) for p in parts]
    return pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "chunk_id", "score"))})


def _broadcast_search(wanted: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    schema = _hit_schema(wanted, corpus)
    # Bounded by the measurement in dense_search.
    rows = wanted.orderBy("query_id").toArrow()
    if rows.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], schema)
    ids = _ids(rows.column("query_id").combine_chunks())
    matrix = _unit_rows(_matrix(rows.column("embedding").combine_chunks()))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        best = least = None
        later, waiting = [], 0
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids_here = _ids(batch.column(0))
            block = _unit_rows(_matrix(batch.column(1)))
            frame = _block_best(query_ids, query_matrix, ids_here, block, k, least)
            later.append(frame)
            waiting += len(frame)
            if best is None or waiting >= len(best):
                best = later[0] if best is None else _merge_best(pd.concat([best, *later]), k)
                least, later, waiting = _least(query_ids, best, k), [], 0
        if best is not None:
            best = _merge_best(pd.concat([best, *later]), k) if waiting else best
            yield pa.RecordBatch.from_pandas(best.reset_index(drop=True), preserve_index=False)

    return spread(corpus, "chunk_id").mapInArrow(score, schema)


def _grid_search(wanted: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    cells = max(1, -(-corpus.count() // ROWS_PER_CELL))
    blocks = max(1, -(-wanted.count() // QUERIES_PER_BLOCK))
    left = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    )
    right = corpus.withColumn("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(cells))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    left = left.select("query_id", "embedding", F.col("block").cast("long"), F.col("cell").cast("long"))
    right = right.select("chunk_id", "embedding", F.col("block").cast("long"), F.col("cell").cast("long"))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        query_matrix = _unit_rows(np.stack(q["embedding"].to_numpy()).astype(np.float64))
        matrix = _unit_rows(np.stack(c["embedding"].to_numpy()).astype(np.float64))
        query_ids, ids = (_ids(pa.array(side)) for side in (q["query_id"], c["chunk_id"]))
        return _block_best(query_ids, query_matrix, ids, matrix, k)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(score, _hit_schema(wanted, corpus))


def scoped_dense_search(
    queries: DataFrame, chunks: DataFrame, k: int, scope: str | tuple[str, ...] = "source_id", vector: str = "embedding"
) -> DataFrame:
    """Dense search where each query only sees chunks with its own ``scope`` values.

    Vectors of a scope are multiplied with the matrix of its questions, batch by
    batch; no (question, chunk) pair becomes a row. A missing scope value sees nothing.
    """
    columns = (scope,) if isinstance(scope, str) else tuple(scope)
    given = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("scope")
    wanted = queries.where(given).select(key, F.col("query_id").cast(_id_type(queries, "query_id")).alias("query_id"), F.col(vector).alias("embedding"))
    # The scopes asked for prune the folders of a corpus that is laid out by them.
    seen = chunks.join(broadcast_checked(queries.where(given).select(*columns).distinct()), list(columns), "left_semi").where(F.col(vector).isNotNull())
    corpus = seen.select(key, F.col("chunk_id").cast(_id_type(chunks, "chunk_id")).alias("chunk_id"), F.col(vector).alias("embedding"))
    search = _scoped_broadcast_search if fits_broadcast(wanted) else _scoped_grid_search
    return top_k(search(wanted, corpus, k), ("query_id",), k, "score", "chunk_id")


def _scoped_broadcast_search(wanted: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    schema = _hit_schema(wanted, corpus)
    rows = wanted.orderBy("scope", "query_id").toArrow()  # bounded by the measurement above
    if rows.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], schema)
    scopes = np.array(rows.column("scope").to_pylist(), dtype=object)
    ids, matrix = _ids(rows.column("query_id").combine_chunks()), _unit_rows(_matrix(rows.column("embedding").combine_chunks()))
    shared = corpus.sparkSession.sparkContext.broadcast({s: (ids[scopes == s], matrix[scopes == s]) for s in set(scopes)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = shared.value, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            named = batch.column(0).dictionary_encode()
            codes = named.indices.to_numpy()
            ids_here, block = _ids(batch.column(1)), _unit_rows(_matrix(batch.column(2)))
            for code, name in enumerate(named.dictionary.to_pylist()):
                if name in asked:
                    here = codes == code
                    frame = _block_best(*asked[name], ids_here[here], block[here], k)
                    best = frame if best is None else pd.concat([best, frame])
            if best is not None and len(best):
                best = _merge_best(best, k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.reset_index(drop=True), preserve_index=False)

    return corpus.mapInArrow(score, schema)


def _scoped_grid_search(wanted: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Every block of a scope's questions meets every cell of its vectors once."""
    largest = lambda df: df.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    cells = max(1, -(-largest(corpus) // ROWS_PER_CELL))
    blocks = max(1, -(-largest(wanted) // QUERIES_PER_BLOCK))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.withColumn("block", number("query_id", blocks)).withColumn("cell", every(cells))
    right = corpus.withColumn("cell", number("chunk_id", cells)).withColumn("block", every(blocks))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        unit = lambda column: _unit_rows(np.stack(column.to_numpy()).astype(np.float64))
        query_ids, ids = (_ids(pa.array(side)) for side in (q["query_id"], c["chunk_id"]))
        return _block_best(query_ids, unit(q["embedding"]), ids, unit(c["embedding"]), k)

    keys = ("scope", "cell", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, _hit_schema(wanted, corpus))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group; the sum is pre-aggregated on every mapper."""
    positions = vectors.select(group, F.posexplode(vector).alias("pos", "x"))
    means = positions.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(vector)
    )


def sparse_dot(query: Column, chunk: Column) -> Column:
    """Dot product of two ``map<term,weight>`` columns."""
    return F.aggregate(
        F.map_entries(query),
        F.lit(0.0),
        lambda acc, e: acc + e["value"].cast("double") * F.coalesce(F.try_element_at(chunk, e["key"]), F.lit(0.0)),
    )
