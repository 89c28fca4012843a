"""Places of normalised passages in raw texts, and overlaps of spans.

Passages (chunks, gold snippets) come with runs of white space made one blank. A map
from places of the normalised text to places of the raw one finds them again: word
characters keep their place, a blank stands for the first character of its run, white
space at both ends is dropped. Passages of a document are looked for in order, each
from the end of the one before, so that repeated boilerplate falls to the passages in
their order; one that is not found ahead is looked for from the start (``exact`` false).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_checked

# All white space of Unicode and the four information separators.
SPACE = r"(?U)[\s\x1c-\x1f]"


def normalised(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    column = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.regexp_replace(F.coalesce(column, F.lit("")), SPACE + "+", " "), F.lit(" "))


class Places:
    """A normalised text and the raw place of each of its characters."""

    def __init__(self, raw: str):
        space = np.fromiter(map(str.isspace, raw), dtype=bool, count=len(raw))
        first = space.copy()
        first[1:] &= ~space[:-1]
        keep = ~space | first
        words = np.flatnonzero(~space)
        if len(words):
            keep[: words[0]] = False
            keep[words[-1] + 1 :] = False
        else:
            keep[:] = False
        self.at = np.flatnonzero(keep)
        self.text = " ".join(raw.split())

    def find(self, passage: str, cursor: int) -> tuple[int, int, int, bool]:
        """Raw start and end, next cursor, and whether it lies at or after ``cursor``; an empty span if nowhere."""
        needle = " ".join(passage.split())
        if not needle:
            return 0, 0, cursor, False
        index = self.text.find(needle, cursor)
        exact = index >= 0
        if not exact:
            index = self.text.find(needle)
        if index < 0:
            return 0, 0, cursor, False
        end = index + len(needle)
        return int(self.at[index]), int(self.at[end - 1]) + 1, end, exact


def locate_passages(documents: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", order: str = "passage_no", content: str = "content") -> DataFrame:
    """``key, order, span_start, span_end, exact, found`` for every passage.

    A document and its passages meet in one task and stream through it in order: it
    holds one text and its map, however many passages follow. Passages of documents
    that are missing, and empty ones, are not found.
    """
    key_type, order_type = passages.schema[key].dataType, passages.schema[order].dataType
    texts = documents.select(F.col(key).cast(key_type).alias("k"), F.lit(0).alias("kind"), F.lit(None).cast(order_type).alias("no"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    wanted = passages.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col(order).alias("no"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    both = texts.join(broadcast_checked(passages.select(F.col(key).alias("k")).distinct()), "k", "left_semi").unionByName(wanted)
    names = [key, order, "span_start", "span_end", "exact", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Places("")
        now, places, cursor = None, nothing, 0
        for batch in batches:
            rows = []
            for k, kind, no, body in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    now, places, cursor = k, nothing, 0
                if kind == 0:
                    places = Places(body)
                    continue
                start, end, cursor, exact = places.find(body, cursor)
                rows.append((k, no, start, end, exact, end > start))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [batch.schema.field(0).type, batch.schema.field(2).type, pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = f"{key} {key_type.simpleString()}, {order} {order_type.simpleString()}, span_start long, span_end long, exact boolean, found boolean"
    return both.where("k IS NOT NULL").repartition("k").sortWithinPartitions("k", "kind", "no").mapInArrow(run, schema)


def overlaps(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 4096) -> DataFrame:
    """Pairs of spans of one ``key`` that share characters, with ``overlap``.

    ``left(key, left_id, start, end)`` and ``right(key, right_id, start, end)``. Spans
    are listed under the cells of ``width`` characters they touch; a pair meets in the
    cell where the later of them starts, so it comes out once. A document with very
    many spans is spread over its cells.
    """
    def celled(df: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
        return df.where("end > start").select(key, f"{name}_id", F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(cells).alias("cell"))

    pairs = celled(left, "left").join(celled(right, "right"), [key, "cell"])
    later = F.greatest("left_start", "right_start")
    shared = F.least("left_end", "right_end") - later
    return pairs.where((shared > 0) & (F.col("cell") == F.floor(later / width))).select(key, "left_id", "right_id", shared.alias("overlap"))
