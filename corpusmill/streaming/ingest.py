"""Continuous ingest and periodic sweeps with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import jobs, security
from corpusmill.operators.catalogue import content_key
from corpusmill.operators.chunking import parent_child
from corpusmill.sources.documents import extract_units
from corpusmill.sources.formats import FORMATS, extension, kind, normalized_filename


def file_stream(spark: SparkSession, path: str, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """New files of a folder as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_batch)
        .load(path)
    )
    name = F.col("path")
    return files.select(
        "path", "modificationTime", normalized_filename(name).alias("filename"), extension(name).alias("extension"), kind(name).alias("kind"), "content",
        content_key(extension(name), F.col("content")).alias("source_id"),
    )


def ingest_batch(files: DataFrame, root: str, pdf_reader=None, ocr=None) -> None:
    """Inspect, extract and chunk one micro-batch into tables under ``root``.

    Contents already stored are skipped by an anti-join, so a replayed batch adds
    nothing. Files with injected instructions are quarantined, not indexed.
    """
    spark = files.sparkSession
    mime = F.lit(None).cast("string")
    for suffix, (_, name) in FORMATS.items():
        mime = F.when(F.col("extension") == suffix, F.lit(name)).otherwise(mime)
    fresh = files.dropDuplicates(["source_id"])
    try:
        known = spark.read.parquet(f"{root}/documents").select("source_id")
        fresh = fresh.join(known, "source_id", "left_anti")
    except Exception as error:  # first batch: the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    checked = security.inspect_files(fresh.withColumn("mime", mime))
    checked.filter("problem IS NOT NULL").select("source_id", "filename", "problem").write.mode("append").parquet(f"{root}/rejects")
    units, warnings = extract_units(checked.filter("problem IS NULL"), pdf_reader, ocr)
    flagged = units.withColumn("findings", security.injection_findings(F.col("content")))
    suspects = flagged.filter(F.size("findings") > 0).select("source_id", "findings")
    suspects.write.mode("append").parquet(f"{root}/quarantine")
    clean = units.join(suspects.select("source_id").distinct(), "source_id", "left_anti")
    parents, children = parent_child(clean)
    parents.write.mode("append").parquet(f"{root}/parents")
    children.write.mode("append").parquet(f"{root}/children")
    warnings.write.mode("append").parquet(f"{root}/warnings")
    # Written last: a batch that failed half-way is repeated as a whole.
    unread = warnings.filter(F.startswith("warning", F.lit("no reader"))).select("source_id")
    done = checked.filter("problem IS NULL").join(unread, "source_id", "left_anti")  # read again once there is a reader
    done.select("source_id", "filename", "kind").write.mode("append").parquet(f"{root}/documents")


def start_ingest(files: DataFrame, root: str, checkpoint: str, once: bool = False, **options):
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(batch, root, **options))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_sweep(spark: SparkSession, read_jobs: Callable[[], DataFrame], dispatch: Callable[[DataFrame], None], checkpoint: str, every: str = "30 seconds"):
    """Re-read the job table on a clock and hand due jobs on (retries, lost leases)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def sweep(batch: DataFrame, _: int) -> None:
        dispatch(jobs.dispatchable(read_jobs(), F.current_timestamp()))

    return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sweep).start()
