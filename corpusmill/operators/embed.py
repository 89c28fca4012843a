"""Model seams: embedder, pair scorer and text generator as Arrow UDFs.

No model ships with the library. The defaults are deterministic stand-ins with
the same call shape, so plans run offline; a real model is passed as a factory
that is called once per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrowtext import WordNumbers, bounded, utf8, words

EMBEDDING_DIMENSIONS = 64
_WORD = re.compile(r"[a-z0-9]+|[㐀-鿿]")

Embedder = Callable[[Sequence[str]], np.ndarray]
PairScorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[str]], Sequence[str]]


def hashing_embedder(dimensions: int = EMBEDDING_DIMENSIONS) -> Embedder:
    """Counts of word hashes; whole text, direction only (dense search normalizes)."""
    known = WordNumbers(lambda word: int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dimensions)

    def embed(texts: Sequence[str]) -> np.ndarray:
        lowered = [(text or "").lower() for text in texts]
        body, edges = utf8(pa.array(lowered, pa.large_string()))
        # Texts with characters of the second part of _WORD are split by it.
        mixed = np.unique(np.searchsorted(edges, np.flatnonzero((body >= 0xE3) & (body <= 0xE9)), "right") - 1).tolist()
        found = [_WORD.findall(lowered[row]) for row in mixed]
        if mixed:
            for row in mixed:
                lowered[row] = ""
            body, edges = utf8(pa.array(lowered, pa.large_string()))
        many, names = words(body, edges)
        rows = np.concatenate([np.repeat(np.arange(len(texts)), many), np.repeat(np.array(mixed, dtype=np.int64), [len(f) for f in found])])
        cells = rows * dimensions + known.of(pa.concat_arrays([names, pa.array([w for f in found for w in f], pa.string())]))
        return np.bincount(cells, minlength=len(texts) * dimensions).astype(np.float32).reshape(len(texts), dimensions)

    embed.texts_at_once = 1024
    return embed


def overlap_scorer() -> PairScorer:
    """Share of the query's distinct words found in the document."""

    def score(queries: Sequence[str], documents: Sequence[str]) -> list[float]:
        out = []
        for query, document in zip(queries, documents):
            words = set(_WORD.findall((query or "").lower()))
            out.append(len(words & set(_WORD.findall((document or "").lower()))) / len(words) if words else 0.0)
        return out

    return score


def embed(column: Column, factory: Callable[[], Embedder] = hashing_embedder, batch: int = 64) -> Column:
    """``array<float>`` embedding of a text column; the model loads once per worker.

    It gets ``batch`` texts, or as many as it names itself as ``texts_at_once``.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        size = getattr(model, "texts_at_once", batch)
        for texts in bounded(batches):
            values = pc.fill_null(texts, "").to_pylist()
            parts = [np.asarray(model(values[i : i + size]), dtype=np.float32) for i in range(0, len(values), size)]
            rows = [row for part in parts for row in part]
            edges = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
            yield pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.float32()))

    return run(column)


def pair_score(
    query: Column, document: Column, factory: Callable[[], PairScorer] = overlap_scorer, batch: int = 64
) -> Column:
    """Relevance of ``document`` for ``query`` from a cross-encoder style model."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, documents in batches:
            q, d = queries.fillna("").tolist(), documents.fillna("").tolist()
            scores: list[float] = []
            for i in range(0, len(q), batch):
                part = list(model(q[i : i + batch], d[i : i + batch]))
                if len(part) != len(q[i : i + batch]):
                    raise RuntimeError("the pair scorer returned a different number of scores")
                scores.extend(float(s) for s in part)
            yield pd.Series(scores, index=queries.index, dtype="float64")

    return run(query, document)


def generate(prompt: Column, factory: Callable[[], Generator]) -> Column:
    """Text generation seam; there is no default model."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(list(model(prompts.fillna("").tolist())), index=prompts.index)

    return run(prompt)


def embed_chunks(chunks: DataFrame, text: str = "content", factory: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col(text), factory))


def fingerprint(chunks: DataFrame, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """One digest over all chunks, independent of order and of partitioning.

    Row digests are folded to fixed-width sums per bucket first, so no list of
    all chunks is ever built.
    """
    row = F.sha2(F.concat_ws("\u0000", F.col(key).cast("string"), F.coalesce(F.col(content), F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    return chunks.agg(F.count("*").alias("chunk_count"), *parts).select(
        "chunk_count",
        F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias(
            "fingerprint"
        ),
    )


def cache_is_valid(meta: DataFrame, model: str, current: DataFrame) -> DataFrame:
    """A stored embedding table may be reused only if model, count and digest agree."""
    return current.join(
        meta.filter(F.col("model") == model).select("chunk_count", "fingerprint"),
        ["chunk_count", "fingerprint"],
        "left_semi",
    )
