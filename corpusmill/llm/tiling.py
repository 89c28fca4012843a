"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item meet through shared seeds: runs of ``min_tile``
tokens with equal Karp-Rabin fingerprints, checked token by token. The longest
common run that is still unmarked in both is marked as a tile, again and again
until none of ``min_tile`` tokens is left. The share of an item's tokens under
tiles decides, so passages that were cut up and put in another order are found.

The benchmark is taken in blocks of bounded bytes, one pass over the documents
each; documents never move. Items with fewer than ``min_tile`` tokens, null and
empty items and texts match nothing. Texts of any length are searched whole.
Repeated rows and items are treated alike, each on its own; null ids are kept.
Empty tables give empty results. Extra columns are ignored by ``tile_matches``
and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import slices

WORD = re.compile(r"\w+")
MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 * 1024 * 1024
BASE = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, item_id long, tiles int, covered int, item_tokens int, coverage double"


def fingerprints(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``width`` token ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    ids = ids.astype(np.uint64)
    value = ids[:n].copy()
    for k in range(1, width):
        value = value * BASE + ids[k : k + n]
    return value


def greedy_tiles(at_doc: np.ndarray, at_item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Tiles ``(doc start, item start, length)`` from the seeds of one pair, longest first.

    Seeds that follow each other on a diagonal form a common run. Ties go to the
    run that starts first in the item, then in the document.
    """
    tiles = []
    order = np.lexsort((at_doc, at_doc - at_item))
    i, j = at_doc[order], at_item[order]
    while len(i):
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(i - j) != 0)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(i)))
        longest = first[length == length.max()]
        best = longest[np.lexsort((i[longest], j[longest]))[0]]
        a, b, n = int(i[best]), int(j[best]), int(length.max()) + width - 1
        tiles.append((a, b, n))
        free = ((i + width <= a) | (i >= a + n)) & ((j + width <= b) | (j >= b + n))
        i, j = i[free], j[free]
    return tiles


class SeedTable:
    """Seeds of a block of benchmark items and their tokens as numbers."""

    def __init__(self, items: list[tuple], width: int):
        self.width, self.names = width, [i for i, _ in items]
        self.number: dict[str, int] = {}
        words = [WORD.findall((t or "").lower()) for _, t in items]
        for w in chain.from_iterable(words):
            self.number.setdefault(w, len(self.number) + 1)
        self.tokens = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        values = [fingerprints(t, width) for t in self.tokens]
        value = np.concatenate(values) if values else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(v) for v in values])
        at = np.concatenate([np.arange(len(v)) for v in values]) if values else np.empty(0, np.int64)
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.at = value[order], item[order], at[order].astype(np.int64)

    def matches(self, texts: list, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """``(text, item, tiles, covered, coverage)`` of the pairs that reach ``least``."""
        if not len(self.value):
            return
        known = [np.fromiter(map(self.number.get, words := WORD.findall((t or "").lower()), repeat(0)), np.int64, len(words)) for t in texts]
        starts = np.cumsum([0] + [len(k) + 1 for k in known])
        # All texts in one row of numbers, a zero between them; unknown words are zero too.
        ids = np.concatenate([part for k in known for part in (k, np.zeros(1, np.int64))]) if known else np.zeros(0, np.int64)
        w = self.width
        if len(ids) < w:
            return
        zeros = np.cumsum(np.append(0, ids == 0))
        places = np.flatnonzero(zeros[w:] == zeros[:-w])
        value = fingerprints(ids, w)[places]
        low, high = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        hit = high > low
        places, low, count = places[hit], low[hit], (high - low)[hit]
        if not len(places):
            return
        where = np.repeat(places, count)
        seed = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        text = np.searchsorted(starts, where, "right") - 1
        item = self.item[seed]
        order = np.lexsort((item, text))
        where, seed, text, item = where[order], seed[order], text[order], item[order]
        edge = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0)))
        for a, b in zip(edge, np.append(edge[1:], len(text))):
            one, tokens, at = int(item[a]), self.tokens[item[a]], self.at[seed[a:b]]
            need = least * len(tokens)
            near = np.zeros(len(tokens) + 1, np.int64)  # tokens that any seed covers: no tiling covers more
            np.add.at(near, at, 1)
            np.add.at(near, at + w, -1)
            if np.count_nonzero(np.cumsum(near[:-1])) < need:
                continue
            spot = where[a:b]
            same = np.all(ids[spot[:, None] + np.arange(w)] == tokens[at[:, None] + np.arange(w)], axis=1)
            tiles = greedy_tiles(spot[same] - starts[text[a]], at[same], w)
            covered = sum(n for _, _, n in tiles)
            if covered >= need:
                yield int(text[a]), one, len(tiles), covered, covered / len(tokens)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Items as ``(item_id, text)`` in blocks of about ``block_bytes``; only one block is held at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def tile_matches(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item whose tokens the document covers to ``coverage``."""
    found = None
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    for items in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            table = SeedTable(items, min_tile)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], table.names[i], n, c, len(table.tokens[i]), share) for t, i, n, c, share in table.matches(batch.column(1).to_pylist(), coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in OUT.split(", ")])

        part = narrow.mapInArrow(run, OUT)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that cover no benchmark item, all columns kept."""
    at = docs.columns.index("text")
    for items in benchmark_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            table = SeedTable(items, min_tile)
            for batch in slices(batches):
                dirty = {t for t, *_ in table.matches(batch.column(at).to_pylist(), coverage)}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
