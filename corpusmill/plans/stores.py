"""Index and embedding store of the documents, built once and then read.

They lie in the shared checkpoint folder under a name made of the files they were
built from (path, size, time of change): a changed table gets new ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import sparse
from corpusmill.operators.vectorstore import VectorStore
from corpusmill.session import ensure_checkpoint_dir, read_table


def files_digest(table: DataFrame) -> str:
    """Digest of the files of a table; no data column is read, one row reaches the driver."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    parts = files.select(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)").alias("h"))
    return parts.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum("h"), F.lit(0)).cast("string"))).alias("d")).first()["d"]


def folder(spark: SparkSession, kind: str, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusmill-{kind}-{name}"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at ``path``; one that failed half way is not."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def kept(make: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, made and written by the first call."""
    if not written(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), "text", "lang"
    )


def document_index(spark: SparkSession, sf_dir: str) -> sparse.SparseIndex:
    """Term vectors of all documents; the first call writes them, later ones find them by the files' digest."""
    path = folder(spark, "terms", files_digest(read_table(spark, sf_dir, "documents")))
    return sparse.SparseIndex(kept(lambda: sparse.build_index(corpus(spark, sf_dir), "text", source_id="source_id").vectors, spark, path))


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, source_id, embedding`` of all documents; texts already stored are not embedded again."""
    store = VectorStore(spark, folder(spark, "vectors", "documents"))
    return store.embedded(corpus(spark, sf_dir).select("chunk_id", "source_id", "text"), "text").select("chunk_id", "source_id", "embedding")
