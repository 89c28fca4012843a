"""Exact top-k inner products with an impact-ordered index.

Components are quantised to integers. Candidates are dealt into blocks of
bounded size, queries into batches; a task meets one block and one batch. In a
block every dimension is a posting list cut into segments of falling value.
Per query the segments of all dimensions are processed by falling impact
(weight times value above the dimension's lowest); what the unread segments of
all dimensions can still add bounds every score. Once that proves that only a
few candidates can be members, these are scored exactly.

Rows with null id, null or empty vector, or null or non-finite components take
no part. Vectors meet only vectors of the same length. Repeated ids are
separate candidates; a query never meets rows of its own id. Ties go to the
smaller id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16384
QUERY_ROWS = 256
LEVELS = 8
CHECK_EVERY = 64
RESCORE_SHARE = 64

OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v`` (integers) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class ImpactIndex:
    """Segments of one block: per dimension, rows by falling value cut at quantised levels."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.low, self.high = self.values[:, 0], self.values[:, -1]
        # Level edges of each dimension, as positions in its sorted list.
        self.edges = []
        for d in range(dims):
            span = int(self.high[d] - self.low[d])
            bounds = self.low[d] + (span * np.arange(1, levels)) // levels
            at = np.unique(np.concatenate([[0], np.searchsorted(self.values[d], bounds), [n]]))
            self.edges.append(at)

    def members(self, query: np.ndarray, k: int, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be in the top k of ``query``, with exact scores."""
        n = len(self.vectors)
        # Segments as (impact, dimension, start, end): impact is the most a row of it can gain.
        segments = []
        base = np.where(query >= 0, query * self.low, query * self.high)
        for d, q in enumerate(query.tolist()):
            if q == 0:
                continue
            at, values = self.edges[d], self.values[d]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                segments.append((q * int(values[b - 1] if q > 0 else values[a]) - int(base[d]), d, a, b))
        segments.sort(reverse=True)
        # Next impact in each dimension after a segment has been read: what rows not yet met there may still gain.
        frontier, following = {}, [0] * len(segments)
        for i in range(len(segments) - 1, -1, -1):
            d = segments[i][1]
            following[i] = frontier.get(d, 0)
            frontier[d] = segments[i][0]
        rest = sum(frontier.values())
        gained = np.zeros(n, np.int64)
        for i, (impact, d, a, b) in enumerate(segments):
            gained[self.order[d, a:b]] += query[d] * self.values[d, a:b] - base[d]
            rest -= impact - following[i]
            if i % CHECK_EVERY == CHECK_EVERY - 1 and rest < int(gained.max() - gained.min()):
                possible = self._possible(gained, rest, k, barred)
                if len(possible) <= max(4 * k, n // RESCORE_SHARE):
                    break
        else:
            possible = self._possible(gained, 0, k, barred)
        return possible, self.vectors[possible] @ query

    @staticmethod
    def _possible(gained, rest, k, barred):
        open_rows = np.flatnonzero(~barred)
        if len(open_rows) <= k:
            return open_rows
        mine = gained[open_rows]
        least = np.partition(mine, len(mine) - k)[len(mine) - k]
        return open_rows[mine + rest >= least]


def _search_cell(k: int):
    def run(candidates, queries):
        import pandas as pd

        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = candidates["vec_id"].to_numpy(np.int64)
        index = ImpactIndex(np.stack(candidates["v"].to_list()).astype(np.int64))
        found = []
        for query_id, vector in zip(queries["vec_id"].tolist(), queries["v"]):
            rows, scores = index.members(np.asarray(vector, np.int64), k, ids == query_id)
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), query_id, np.int64), ids[rows][best], scores[best]))
        return pd.DataFrame({c: np.concatenate(parts) for c, parts in zip(("query_id", "vec_id", "score"), zip(*found))})

    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every ``every``-th id."""
    clean = quantised(vectors, scale)
    sizes = clean.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q")).first()
    blocks, batches = max(1, math.ceil(sizes["n"] / block_rows)), max(1, math.ceil(sizes["q"] / query_rows))
    keyed = clean.withColumn("dims", F.size("v"))
    deal = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every_cell = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = keyed.withColumn("block", deal(1, blocks)).withColumn("batch", every_cell(batches))
    right = keyed.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("batch", deal(2, batches)).withColumn("block", every_cell(blocks))
    key = ["dims", "block", "batch"]
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search_cell(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
