"""Containment joins: which texts contain which terms, without a cross join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrowtext import Holders
from corpusmill.functions.text import char_ngrams
from corpusmill.session import WIDE_READ_ROWS, broadcast_checked, fits_broadcast, spread, stage_few, wide_rows

KEY_CHARS = 16


def _hashed_windows(text: Column, size: int) -> Column:
    return F.transform(char_ngrams(text, size), lambda window: F.xxhash64(window, F.lit(size)))


def contains_pairs(
    texts: DataFrame, terms: DataFrame, text_id: str, text: str, term_id: str, term: str
) -> DataFrame:
    """All ``(text_id, term_id)`` with ``term`` a substring of ``text``.

    Terms that fit a broadcast are looked for by their first characters (at most 16)
    where the texts lie. Otherwise every term is known by the hash of these, every
    text by the hashes of its windows of those lengths, and the equi-join on hashes
    gives the candidates. A real containment test settles them.
    """
    heads = terms.filter(F.length(term) > 0).select(F.col(term_id), F.substring(F.col(term), 1, KEY_CHARS).alias("_key"))
    if fits_broadcast(terms.select(term_id, term)):
        return _placed_pairs(texts, terms, heads, text_id, text, term_id, term)
    keyed = terms.filter(F.length(term) > 0).select(
        F.col(term_id), F.col(term), F.least(F.length(term), F.lit(KEY_CHARS)).alias("_len")
    )
    lengths = [r["_len"] for r in keyed.select("_len").distinct().collect()]  # at most 16 numbers
    if not lengths:
        return texts.select(text_id).limit(0).join(terms.select(term_id).limit(0), F.lit(False))
    keyed = keyed.withColumn("_key", F.xxhash64(F.substring(F.col(term), F.lit(1), F.col("_len")), F.col("_len")))
    base = spread(texts, text_id).select(text_id, text)
    windows = base.select(
        text_id,
        F.explode_outer(
            F.array_distinct(F.flatten(F.array(*[_hashed_windows(F.col(text), n) for n in sorted(lengths)])))
        ).alias("_key"),
    )
    candidates = windows.join(broadcast_checked(keyed.select(term_id, "_key")), "_key").select(text_id, term_id)
    candidates = candidates.join(broadcast_checked(terms.select(term_id, term)), term_id)
    return candidates.join(base, text_id).filter(F.contains(text, F.col(term))).select(text_id, term_id)


def _placed_pairs(texts: DataFrame, terms: DataFrame, heads: DataFrame, text_id: str, text: str, term_id: str, term: str) -> DataFrame:
    """``contains_pairs`` for terms that were measured: only pairs leave the texts."""
    # Bounded by the measurement.
    known = [r["_key"] for r in heads.select("_key").distinct().collect()]
    if not known:
        return texts.select(text_id).limit(0).join(terms.select(term_id).limit(0), F.lit(False))
    base = spread(texts, text_id).select(text_id, text)
    shared = base.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([base.schema[text_id], T.StructField("_key", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = Holders(shared.value)
        for batch in batches:
            rows, keys = holders.rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], names=[text_id, "_key"])

    # Terms fit a broadcast, and so do their heads.
    found = base.mapInArrow(find, schema).join(F.broadcast(heads), "_key").select(text_id, term_id)
    with wide_rows(base.sparkSession, WIDE_READ_ROWS):
        few = stage_few(found, "holders")
    candidates = few.join(F.broadcast(terms.select(term_id, term)), term_id)
    candidates = broadcast_checked(candidates) if fits_broadcast(few) else candidates
    return candidates.join(texts.select(text_id, text), text_id).filter(F.contains(text, F.col(term))).select(text_id, term_id)
