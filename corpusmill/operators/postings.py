"""Persisted lexical index: segments of posting blocks, with pruned BM25 search.

A segment is written once and never changed. Its chunks are ordered and cut into
windows of ``window`` chunks; a block holds the postings of one term in one window
and, as plain columns before them, their number, the largest term frequency and the
smallest chunk length. These bound any BM25 score of the block, whatever ``k1``,
``b`` and the mean length are. Blocks lie in folders by term hash.

A search reads the block heads of the query terms first, in their folders only. The
heads give document frequencies, and their bounds add up to a bound of every
(query, window). The windows with the highest bounds are scored, which yields a
score that k chunks reach; then only windows whose bound is not below it are scored.
The result is that of scoring every chunk. Where the questions have few postings in
all (``prune_above``), scoring them in one pass costs less than finding out which
windows to leave out.

Segments are added and merged by size; deleted chunks are listed with the number of
postings each term loses, so statistics are those of the live chunks: sums over
segments less sums over deletions. A numbered manifest names what is live; readers
of an older number still find its files. There is one writer at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.sparse import _list_rows, idf, query_terms, term_score, top_k
from corpusmill.session import BROADCAST_LIMIT_BYTES, broadcast_checked, stage

BUCKETS = 64
WINDOW = 128  # a power of two: row numbers of a partition start at a multiple of it
FIRST_WINDOWS = 8
MERGE_AT = 8
PRUNE_ABOVE = 50_000_000
MARGIN = 1e-6  # far above the rounding of a sum of scores
ENTRY = "array<struct<slot: int, tf: int, length: int>>"
MADE = f"term string, window long, n int, max_tf int, min_length int, entries {ENTRY}"
BLOCKS = f"{MADE}, segment int, bucket int"
DOCS = "window long, slot int, chunk_id {id}, ordinal {ordinal}, source_id string, length int, segment int"
MANIFEST = "kind string, name int, segment int, n_chunks long, total_length long, version int"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the chunks of each batch. A window in two batches has two blocks of a term: all uses add them up."""
    for batch in batches:
        window, slot, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        rows, coded = _list_rows(batch.column(3)), batch.column(3).flatten().dictionary_encode()
        if not len(rows):
            continue
        code, tf = coded.indices.to_numpy(zero_copy_only=False), batch.column(4).flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((slot[rows], window[rows], code))
        rows, code, tf = rows[order], code[order], tf[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(window[rows]) != 0)]))
        ints = lambda values: pa.array(values, pa.int32())
        entries = pa.StructArray.from_arrays([ints(slot[rows]), ints(tf), ints(length[rows])], ["slot", "tf", "length"])
        columns = [
            coded.dictionary.take(pa.array(code[starts])), pa.array(window[rows][starts]), ints(np.diff([*starts, len(rows)])),
            ints(np.maximum.reduceat(tf, starts)), ints(np.minimum.reduceat(length[rows], starts)), pa.ListArray.from_arrays(ints([*starts, len(rows)]), entries),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "window", "n", "max_tf", "min_length", "entries"])


class PostingStore:
    """An index under ``root``; any path that Spark can write and read."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, window: int = WINDOW, first_windows: int = FIRST_WINDOWS, merge_at: int = MERGE_AT, prune_above: int = PRUNE_ABOVE):
        if window & (window - 1):
            raise ValueError("window must be a power of two")
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets, self.window, self.first_windows, self.merge_at, self.prune_above = buckets, window, first_windows, merge_at, prune_above
        self.broadcast_bytes = BROADCAST_LIMIT_BYTES
        self._doc_schema = None

    # Manifest

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first."""
        versions = self._versions()
        return (versions.agg(F.max("version")).first()[0] or 0) if versions is not None else 0

    def entries(self) -> list[dict]:
        """Live segments and deletions; merging keeps them few."""
        versions = self._versions()
        if versions is None:
            return []
        newest = versions.agg(F.max("version").alias("newest")).select("newest").scalar()
        return [r.asDict() for r in versions.where(F.col("version") == newest).collect()]

    def _publish(self, entries: list[dict], expected: int) -> None:
        if self.version() != expected:
            raise RuntimeError("the index was changed by another writer")
        rows = [(e["kind"], e["name"], e["segment"], e["n_chunks"], e["total_length"], expected + 1) for e in entries]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.root}/manifest")

    @staticmethod
    def _live(entries: list[dict]) -> list[int]:
        return sorted(e["segment"] for e in entries if e["kind"] == "segment")

    @staticmethod
    def _next(entries: list[dict]) -> int:
        return max((e["name"] for e in entries), default=0) + 1

    # Files

    def _blocks(self, segments: list[int], folders: list[int] | None = None) -> DataFrame:
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/blocks").where(F.col("segment").isin(segments))
        return blocks if folders is None else blocks.where(F.col("bucket").isin(folders))

    def _docs(self, entries: list[dict]) -> DataFrame:
        """Live chunks."""
        reader = self.spark.read if self._doc_schema is None else self.spark.read.schema(self._doc_schema)
        docs = reader.parquet(f"{self.root}/docs")
        self._doc_schema = docs.schema  # the same in all segments
        return self._without_deleted(docs.where(F.col("segment").isin(self._live(entries))), entries)

    def _part(self, kind: str, entries: list[dict]) -> DataFrame | None:
        names = sorted({e["name"] for e in entries if e["kind"] == "delete"})
        return self.spark.read.parquet(f"{self.root}/{kind}").where(F.col("deletion").isin(names)) if names else None

    def _without_deleted(self, rows: DataFrame, entries: list[dict]) -> DataFrame:
        deleted = self._part("deleted", entries)
        if deleted is None:
            return rows
        gone = deleted.select("segment", "window", "slot")
        return rows.join(broadcast_checked(gone), ["segment", "window", "slot"], "left_anti")

    def docs(self) -> DataFrame:
        """``segment, window, slot, chunk_id, ordinal, source_id, length`` of all live chunks."""
        return self._docs(self.entries())

    # Changes

    def _write_segment(self, vectors: DataFrame, name: int) -> tuple[int, int]:
        """Write one segment of term vectors; its number of chunks and their total length."""
        ordered = vectors.repartitionByRange("ordinal", "chunk_id").sortWithinPartitions("ordinal", "chunk_id").withColumn("at", F.monotonically_increasing_id())
        place = ordered.select(
            F.floor(F.col("at") / self.window).cast("long").alias("window"), (F.col("at") % self.window).cast("int").alias("slot"),
            "chunk_id", "ordinal", F.col("source_id").cast("string").alias("source_id"), F.col("length").cast("int").alias("length"), "terms",
        )
        numbered = stage(place, "numbered")
        numbered.drop("terms").write.mode("overwrite").parquet(f"{self.root}/docs/segment={name}")
        # Chunks of a window lie side by side, so its blocks are made where they lie.
        blocks = numbered.select("window", "slot", "length", F.col("terms.term").alias("names"), F.col("terms.tf").alias("tfs")).mapInArrow(_blocks_of, MADE)
        placed = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        order = ["bucket", "term", "window"]
        placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/blocks/segment={name}")
        total = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        return total["n"], total["total"]

    def add(self, vectors: DataFrame) -> tuple[int, int]:
        """Add chunks (``chunk_id, ordinal, source_id, length, terms``) as a segment.

        Sources that the index already holds are left as they are. Returns the
        chunks added and the chunks refused.
        """
        entries, version = self.entries(), self.version()
        vectors = stage(vectors.select("chunk_id", "ordinal", F.col("source_id").cast("string").alias("source_id"), "length", "terms"), "vectors")
        given = vectors.count()
        if self._live(entries):
            held = self._docs(entries).select("source_id").distinct()
            vectors = vectors.join(broadcast_checked(held), "source_id", "left_anti").select(*vectors.columns)
        name = self._next(entries)
        count, total = self._write_segment(vectors, name)
        if count:
            entries.append({"kind": "segment", "name": name, "segment": name, "n_chunks": count, "total_length": total})
            self._publish(entries, version)
            self._merge_tiers()
        return count, given - count

    def delete(self, gone: DataFrame) -> int:
        """Delete the live chunks whose ``source_id`` (or ``chunk_id``) is in ``gone``; returns how many."""
        entries, version = self.entries(), self.version()
        if not entries:
            return 0
        key = "chunk_id" if "chunk_id" in gone.columns else "source_id"
        name = self._next(entries)
        hit = self._docs(entries).join(broadcast_checked(gone.select(key).distinct()), key, "left_semi").select("segment", "window", "slot", "length")
        hit.write.mode("overwrite").parquet(f"{self.root}/deleted/deletion={name}")
        hit = self.spark.read.parquet(f"{self.root}/deleted/deletion={name}")
        counts = hit.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("total")).collect()
        if not counts:
            return 0
        parts = self._blocks([r["segment"] for r in counts]).join(broadcast_checked(hit.select("segment", "window").distinct()), ["segment", "window"], "left_semi")
        lost = parts.select("segment", "window", "term", F.explode("entries").alias("e")).select("segment", "window", F.col("e.slot").alias("slot"), "term")
        lost = lost.join(broadcast_checked(hit.select("segment", "window", "slot")), ["segment", "window", "slot"], "left_semi")
        lost.groupBy("segment", "term").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.root}/lost/deletion={name}")
        entries += [{"kind": "delete", "name": name, "segment": r["segment"], "n_chunks": -r["n"], "total_length": -r["total"]} for r in counts]
        self._publish(entries, version)
        return sum(r["n"] for r in counts)

    def merge(self, segments: list[int] | None = None) -> None:
        """Rewrite ``segments`` (all of them by default) as one without their deleted chunks."""
        entries, version = self.entries(), self.version()
        segments = sorted(self._live(entries) if segments is None else segments)
        if not segments:
            return
        docs = self._docs(entries).where(F.col("segment").isin(segments))
        # Blocks and chunks meet by window, which holds a bounded number of both.
        postings = self._blocks(segments).select("segment", "window", "term", F.explode("entries").alias("e")).select("segment", "window", F.col("e.slot").alias("slot"), F.struct("term", F.col("e.tf").alias("tf")).alias("t"))
        terms = postings.groupBy("segment", "window", "slot").agg(F.collect_list("t").alias("terms"))
        vectors = docs.join(terms, ["segment", "window", "slot"], "left")
        none = F.array().cast("array<struct<term: string, tf: int>>")
        name = self._next(entries)
        count, total = self._write_segment(vectors.withColumn("terms", F.coalesce("terms", none)), name)
        kept = [e for e in entries if e["segment"] not in segments]
        self._publish([*kept, {"kind": "segment", "name": name, "segment": name, "n_chunks": count, "total_length": total}], version)

    def _merge_tiers(self) -> None:
        """Merge a tier (segments of about the same size) once it has ``merge_at`` members."""
        tiers: dict[int, list[int]] = {}
        for e in self.entries():
            if e["kind"] == "segment":
                tiers.setdefault(int(math.log(max(1, e["n_chunks"]), self.merge_at)), []).append(e["segment"])
        for members in tiers.values():
            if len(members) >= self.merge_at:
                self.merge(members)
                return self._merge_tiers()

    def describe(self, sources: DataFrame | None = None) -> DataFrame:
        """``source_id, name, source_type, chunk_count, selected_by_default, status`` per source.

        ``sources`` may name some of them; sources known to the index alone get
        their id as name.
        """
        counted = self.docs().where("coalesce(source_id, '') <> ''").groupBy("source_id").agg(F.count("*").alias("n"))
        if sources is None:
            known = counted.select("source_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("boolean").alias("selected_by_default"), F.lit(None).cast("string").alias("status")).limit(0)
        else:
            have = lambda c, t: F.col(c).cast(t) if c in sources.columns else F.lit(None).cast(t)
            known = sources.where("coalesce(trim(source_id), '') <> ''").select(
                F.trim("source_id").alias("source_id"), have("name", "string").alias("name"), have("source_type", "string").alias("source_type"),
                have("selected_by_default", "boolean").alias("selected_by_default"), have("status", "string").alias("status"),
            )
        return counted.join(known, "source_id", "full").select(
            "source_id", F.coalesce("name", "source_id").alias("name"), F.coalesce("source_type", F.lit("document")).alias("source_type"),
            F.coalesce("n", F.lit(0)).alias("chunk_count"), F.coalesce("selected_by_default", F.lit(False)).alias("selected_by_default"), F.coalesce("status", F.lit("ready")).alias("status"),
        )

    def statistics(self) -> tuple[int, float]:
        """Live chunks and their mean length (1 without chunks)."""
        return self._statistics(self.entries())

    @staticmethod
    def _statistics(entries: list[dict]) -> tuple[int, float]:
        count = sum(e["n_chunks"] for e in entries)
        return count, (sum(e["total_length"] for e in entries) / count if count else 1.0)

    def document_frequency(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """``term, df`` of live chunks, for all terms or those of ``vocabulary``."""
        entries = self.entries()
        return self._frequencies(self._blocks(self._live(entries)) if vocabulary is None else self._blocks(self._live(entries)).join(broadcast_checked(vocabulary), "term", "left_semi"), entries)

    def _frequencies(self, heads: DataFrame, entries: list[dict]) -> DataFrame:
        counts = heads.select("term", F.col("n").cast("long").alias("n"))
        lost = self._part("lost", entries)
        if lost is not None:
            live = lost.where(F.col("segment").isin(self._live(entries)))
            counts = counts.unionByName(live.select("term", (-F.col("n")).cast("long").alias("n")))
        return counts.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    # Search

    def search(
        self, queries: DataFrame, k: int, text: str = "text", keys: tuple[str, ...] = ("query_id",), k1: float = 1.4, b: float = 0.72,
        allowed: DataFrame | None = None, query_factor: bool = True, distinct_terms: bool = True, with_terms: bool = False,
    ) -> DataFrame:
        """Top ``k`` live chunks per query, with the columns of ``sparse.bm25_search``."""
        k1, b = max(0.01, float(k1)), min(max(0.0, float(b)), 1.0)
        entries = self.entries()
        segments = self._live(entries)
        count, mean = self._statistics(entries)
        terms = stage(query_terms(queries, text, keys).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")), "terms")
        if not segments:
            columns = [*[f"{c} {terms.schema[c].dataType.simpleString()}" for c in keys], "chunk_id long, ordinal long, source_id string, score double", *(["matched_terms array<string>"] if with_terms else []), "rank int"]
            return self.spark.createDataFrame([], ", ".join(columns))
        # At most ``buckets`` numbers; the size is measured in the same pass.
        asked = terms.agg(F.collect_set("bucket").alias("folders"), F.sum(F.octet_length("term") + 60).alias("bytes")).first()
        folders, small = sorted(asked["folders"]), (asked["bytes"] or 0) <= self.broadcast_bytes
        of_terms = lambda df: F.broadcast(df) if small else df
        vocabulary = terms.select("term").distinct()
        blocks = self._blocks(segments, folders)
        heads = stage(blocks.select("segment", "term", "window", "n", "max_tf", "min_length").join(of_terms(vocabulary), "term", "left_semi"), "heads")
        factor = F.col("qf").cast("double") if not distinct_terms else (F.lit(1.0) + F.log(F.col("qf")) if query_factor else F.lit(1.0))
        frequencies = self._frequencies(heads, entries)
        weighed = terms.join(of_terms(frequencies) if small else frequencies, "term")
        weights = stage(weighed.select(*keys, "term", "position", "df", (idf(F.lit(count), F.col("df")) * factor).alias("weight")), "weights")

        def scored(pairs: DataFrame | None) -> DataFrame:
            """Top k of the chunks in the (query, window) ``pairs``, or of all chunks."""
            held, docs = blocks.select("segment", "term", "window", "entries"), self._docs(entries)
            if pairs is None:
                wanted = held.join(of_terms(weights), "term")
            else:
                needed = pairs.select("segment", "window").distinct()
                held = held.join(broadcast_checked(needed), ["segment", "window"], "left_semi")
                docs = docs.join(broadcast_checked(needed), ["segment", "window"], "left_semi")
                wanted = held.join(of_terms(weights), "term").join(broadcast_checked(pairs), [*keys, "segment", "window"], "left_semi")
            each = wanted.select(*keys, "segment", "window", "term", "position", "weight", F.explode("entries").alias("e"))
            each = each.select(*keys, "segment", "window", F.col("e.slot").alias("slot"), "term", "position", term_score(F.col("weight"), F.col("e.tf"), F.col("e.length"), F.lit(mean), k1, b).alias("part"))
            found = [F.sum("part").alias("score")]
            if with_terms:
                found.append(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda s: s["term"]).alias("matched_terms"))
            sums = each.groupBy(*keys, "segment", "window", "slot").agg(*found).where("score > 0")
            if allowed is not None and "query_id" not in allowed.columns:
                docs = docs.join(broadcast_checked(allowed.select("source_id").distinct()), "source_id", "left_semi")
            hits = sums.join(docs.select("segment", "window", "slot", "chunk_id", "ordinal", "source_id"), ["segment", "window", "slot"])
            if allowed is not None and "query_id" in allowed.columns:
                hits = hits.join(allowed, list(allowed.columns), "left_semi")
            return top_k(hits.select(*keys, "chunk_id", "ordinal", "source_id", "score", *(["matched_terms"] if with_terms else [])), keys, k)

        if (weights.agg(F.sum("df")).first()[0] or 0) <= self.prune_above:
            return scored(None)
        bound = term_score(F.col("weight"), F.col("max_tf"), F.col("min_length"), F.lit(mean), k1, b)
        bounds = stage(heads.join(of_terms(weights), "term").groupBy(*keys, "segment", "window").agg(F.sum(bound).alias("bound")), "bounds")
        first = top_k(bounds, keys, self.first_windows, "bound", "segment", "window")
        best = stage(scored(first.select(*keys, "segment", "window")), "first")
        floor = best.where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
        rest = bounds.join(first.select(*keys, "segment", "window"), [*keys, "segment", "window"], "left_anti").join(broadcast_checked(floor), list(keys), "left")
        rest = rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN)).select(*keys, "segment", "window")
        return top_k(best.drop("rank").unionByName(scored(stage(rest, "rest")).drop("rank")), keys, k)
