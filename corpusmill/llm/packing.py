"""Best-fit packing of documents into training windows with conflicts.

Texts longer than a window are cut into full windows and a rest. Pieces are
packed longest first: bins are ordered by the room they have left, and the
search walks up from the smallest sufficient room until it finds a bin that
holds neither the piece's source nor its duplicate cluster (both kept as bitmaps).

Rows are dealt evenly over tasks (round robin, so no key can gather in one task)
and packed in groups of ``group_rows``; a bin never spans groups, which costs at
most a few unfilled bins per group. Sizes are counts of words separated by
white space.

Null and empty texts have no words: they are returned with null bin. A null
source conflicts with nothing. Without a ``cluster`` equal texts form one; op9
packs groups of near copies (``jaccard.sized_clusters``). Repeated rows are
packed each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import stage

CAPACITY = 2048
GROUP_ROWS = 4096
TASK_ROWS = 32768
OUT = "doc_id long, piece int, start long, n_words long, part int, bin long, bin_offset long"


class Bins:
    """Open bins by room left; two bitmaps per bin."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # distinct rooms, ascending
        self.at_room: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _file(self, b: int, room: int) -> None:
        if room in self.at_room:
            insort(self.at_room[room], b)
        else:
            insort(self.rooms, room)
            self.at_room[room] = [b]

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; ``source`` and ``cluster`` are one-bit masks or 0."""
        for k in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[k]
            here = self.at_room[room]
            for n, b in enumerate(here):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    del here[n]
                    if not here:
                        del self.at_room[room], self.rooms[k]
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    offset = self.used[b]
                    self.used[b] += size
                    if room > size:
                        self._file(b, room - size)
                    return b, offset
        b = len(self.used)
        self.sources.append(source)
        self.clusters.append(cluster)
        self.used.append(size)
        if size < self.capacity:
            self._file(b, self.capacity - size)
        return b, 0


def pack_group(rows: list[tuple], capacity: int) -> list[tuple]:
    """``(doc_id, piece, start, size, bin, offset)`` for ``(doc_id, source, cluster, size)`` rows."""
    pieces = []
    for doc, source, cluster, size in rows:
        for n in range(math.ceil(size / capacity)):
            pieces.append((min(capacity, size - n * capacity), doc, n, source, cluster))
        if not size:
            pieces.append((0, doc, 0, source, cluster))
    pieces.sort(key=lambda p: (-p[0], p[1] is not None, p[1] or 0, p[2]))
    bits: tuple[dict, dict] = ({}, {})
    mask = lambda which, value: 0 if value is None else 1 << bits[which].setdefault(value, len(bits[which]))
    bins, out = Bins(capacity), []
    for size, doc, n, source, cluster in pieces:
        b, offset = bins.put(size, mask(0, source), mask(1, cluster)) if size else (None, None)
        out.append((doc, n, n * capacity, size, b, offset))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``pack_sized`` of texts, with a hash of the text as cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("cluster"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("size"),
    )
    return pack_sized(sized, docs.count(), capacity, group_rows, task_rows)


def pack_clusters(clustered: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``pack_sized`` of rows whose clusters are costly: written before they are counted and packed."""
    sized = stage(clustered.select("doc_id", "source", "cluster", "size"), "sized")
    return pack_sized(sized, sized.count(), capacity, group_rows, task_rows)


def pack_sized(sized: DataFrame, n_rows: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_words, part, bin, bin_offset``.

    ``(part, bin)`` names a bin. Takes ``doc_id, source, cluster, size``, where
    ``cluster`` equals within groups of duplicates.
    """
    tasks = max(1, math.ceil(n_rows / task_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, held = TaskContext.get().partitionId(), 0, []

        def packed():
            nonlocal first, held
            rows = pack_group(held, capacity)
            top = max((r[4] for r in rows if r[4] is not None), default=-1)
            columns = [*zip(*[(d, n, s, size, part if b is not None else None, first + b if b is not None else None, o) for d, n, s, size, b, o in rows])]
            first, held = first + top + 1, []
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in OUT.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= group_rows:
                    yield packed()
        if held:
            yield packed()

    return sized.repartition(tasks).mapInArrow(run, OUT)
