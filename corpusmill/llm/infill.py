"""Fill-in-middle texts: cuts at token ranks found in an indexable skip list.

A text is a list of tokens (white space with the word behind it; white space at
the end is a token of its own). Its skip list has a base lane with one link per
token and express lanes above it; every link carries the number of tokens and the
number of code points it spans. A cut rank is reached by walking a lane as long as
its links do not overshoot and then going one lane down; the code points passed
give the place of the cut exactly.

``h1`` to ``h4`` are the first four 8-digit groups of the hexadecimal SHA-256 of
``<seed>:<doc_id>``. Null texts are empty; empty texts, and texts that hold a mark,
stay plain. A null doc_id hashes as empty digits. Texts of any length are cut
whole; memory is that of one text and its lanes. Repeated rows are each returned.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INFILL_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
SEED = 42
LANE_BITS = 2  # a link of one lane spans about 2**LANE_BITS links of the lane below
OUT_BYTES = 8 << 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

SPACES = np.zeros(0x21, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def token_chars(text: str) -> np.ndarray:
    """Code points of each token of ``text``, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    space = SPACES[np.minimum(points, 0x20)] & (points <= 0x20)
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True  # a word, or the white space behind the last one
    return np.diff(np.flatnonzero(last) + 1, prepend=0)


def heights(n: int) -> np.ndarray:
    """Lanes above the base of each of ``n`` nodes: a hash of the place, so equal texts have equal lists."""
    x = np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    low = x & (~x + np.uint64(1))  # lowest set bit
    return (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) / LANE_BITS).astype(np.int64)


class SkipList:
    """Lanes of links, each with its width in units and in code points."""

    def __init__(self, chars: np.ndarray):
        self.units: list[np.ndarray] = [np.ones(len(chars), dtype=np.int64)]
        self.points: list[np.ndarray] = [np.asarray(chars, dtype=np.int64)]
        self.below: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]  # node of the lane below
        tall, lane = heights(len(chars)), 1
        at = np.arange(len(chars))
        while len(at) > 1:
            keep = tall[at] >= lane
            keep[0] = True  # the head is in every lane
            down = np.flatnonzero(keep)
            if len(down) == len(at):
                lane += 1
                continue
            self.units.append(np.add.reduceat(self.units[-1], down))
            self.points.append(np.add.reduceat(self.points[-1], down))
            self.below.append(down)
            at, lane = at[down], lane + 1

    def offset(self, rank: int) -> int:
        """Code points before the token of number ``rank`` (from 0)."""
        node, units, points = 0, 0, 0
        for lane in range(len(self.units) - 1, -1, -1):
            widths, chars = self.units[lane], self.points[lane]
            while node < len(widths) and units + widths[node] <= rank:
                units += int(widths[node])
                points += int(chars[node])
                node += 1
            if units == rank:
                return points
            node = int(self.below[lane][node]) if lane else node
        raise IndexError(rank)


def draws(doc_id: int | None, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def infill(doc_id: int | None, text: str | None, seed: int = SEED) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    text = text or ""
    chars = token_chars(text)
    n = len(chars)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= INFILL_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lanes = SkipList(chars)
    first, second = (lanes.offset(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", first, second - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def infill_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document ``doc_id, n, form, prefix_chars, middle_chars, output``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in OUT.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *infill(doc_id, text.as_py(), seed)))
                held += 4 * len(rows[-1][-1])
                if held >= OUT_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def restored(output, form):
    """The text again, from ``output`` and ``form`` columns."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def infill_digest(docs: DataFrame) -> DataFrame:
    """The transformed documents with digests instead of texts."""
    return infill_documents(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"),
    )
