"""Content-addressed store of embeddings: a text is embedded once per model.

Vectors lie in append-only batches under the digest of their text. A call embeds
only the digests that no published batch of its model holds; equal texts count
once. A batch is visible when its entry in ``batches`` is, so that one left behind
by a failed job is never read. All vectors of a model have one dimension: a batch
of another one is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import text_of
from corpusmill.operators.embed import Embedder, embed, hashing_embedder

VECTORS = "digest string, embedding array<float>, model string, batch string"
BATCHES = "batch string, model string, n_vectors long, dimensions int, embedded_at timestamp"


def digest(text: Column | str) -> Column:
    return F.sha2(F.encode(text_of(text), "UTF-8"), 256)


def _first_of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every digest; all rows of a digest are in one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, value in enumerate(batch.column(0).to_pylist()):
            key = bytes.fromhex(value)
            if key not in seen:
                seen.add(key)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


class VectorStore:
    """Vectors of one ``model`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, model: str = "hashing", factory: Callable[[], Embedder] = hashing_embedder):
        self.spark, self.root, self.model, self.factory = spark, root.rstrip("/"), model, factory

    def batches(self) -> DataFrame:
        """Published batches of the model."""
        try:
            return self.spark.read.schema(BATCHES).parquet(f"{self.root}/batches").where(F.col("model") == self.model)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], BATCHES)

    def vectors(self) -> DataFrame:
        """``digest, embedding`` of every stored text; only the folders of published batches are read."""
        named = [r["batch"] for r in self.batches().select("batch").collect()]  # one row per call that embedded
        if not named:
            return self.spark.createDataFrame([], VECTORS).select("digest", "embedding")
        held = self.spark.read.schema(VECTORS).parquet(f"{self.root}/vectors")
        return held.where((F.col("model") == self.model) & F.col("batch").isin(named)).select("digest", "embedding")

    def add(self, texts: DataFrame, text: str = "content") -> int:
        """Embed and store the texts not stored yet; returns how many."""
        # Equal texts meet without being sorted: dropDuplicates would sort whole texts twice.
        wanted = texts.select(digest(text).alias("digest"), text_of(text).alias("text")).repartition("digest")
        fresh = wanted.join(self.vectors().select("digest"), "digest", "left_anti").mapInArrow(_first_of_digest, "digest string, text string")
        batch = uuid.uuid4().hex
        path = f"{self.root}/vectors/model={self.model}/batch={batch}"
        # Sorted by digest, so that a later join reads its side in order of row groups.
        fresh.select("digest", embed(F.col("text"), self.factory).alias("embedding")).sortWithinPartitions("digest").write.parquet(path)
        written = self.spark.read.schema("digest string, embedding array<float>").parquet(path)
        found = written.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
        if not found["n"]:
            return 0
        have = self.batches().agg(F.max("dimensions")).first()[0]
        if found["low"] != found["high"] or (have is not None and have != found["high"]):
            raise ValueError(f"embeddings have {found['low']} to {found['high']} dimensions, the store has {have}")
        entry = self.spark.createDataFrame([(batch, self.model, found["n"], found["high"])], "batch string, model string, n_vectors long, dimensions int")
        entry.withColumn("embedded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/batches")
        return found["n"]

    def embedded(self, chunks: DataFrame, text: str = "content", into: str = "embedding") -> DataFrame:
        """``chunks`` with the vector of their text, embedding what is missing first."""
        self.add(chunks, text)
        return chunks.withColumn("_digest", digest(text)).join(self.vectors().select(F.col("digest").alias("_digest"), F.col("embedding").alias(into)), "_digest", "left").drop("_digest")
