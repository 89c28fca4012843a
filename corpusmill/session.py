"""Session settings and the size checks that guard every broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side we ask Spark to broadcast. The side is measured first; a bigger
# one takes the shuffle path of the same operator.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# What a task holds of wide rows at once: bytes of an Arrow batch and of a Parquet
# row group, rows of a Parquet read.
WIDE_BATCH_BYTES = 2 * 1024 * 1024
WIDE_GROUP_BYTES = 8 * 1024 * 1024
WIDE_READ_ROWS = 512


def get_spark(app_name: str = "corpusmill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on (UTC clock, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``.

    A cluster names its shared folder in ``spark.checkpoint.dir``; only when
    that is unset on a single machine, as in tests, do we pick a folder ourselves.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _column_bytes(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 20
    if isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)
    ):
        return F.coalesce(F.size(column), F.lit(0)).cast("long") * 8 + 24
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long") + 24
    return F.lit(16).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of ``df`` take, measured with one distributed aggregate."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        total = total + _column_bytes(field)
    return int(df.agg(F.sum(total).alias("b")).first()["b"] or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return measured_bytes(df) <= limit


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def broadcast_bounded(df: DataFrame, max_rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast when the operator itself bounds the rows (a top k per query).

    Nothing is executed to find out; above the limit the join is left to AQE.
    """
    return F.broadcast(df) if max_rows * row_bytes <= limit else df


def salted_join(big: DataFrame, small: DataFrame, on: str, salt_by: str, salts: int = 32) -> DataFrame:
    """Inner equi-join whose hot keys are spread over ``salts`` reducers.

    ``big`` rows of one key are spread by a hash of ``salt_by``; each ``small``
    row is repeated once per salt, so the result is exactly the plain join.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [on, "_salt"]).drop("_salt")


@contextmanager
def wide_rows(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Jobs started inside move rows of several kB in batches bounded by bytes.

    By default 10,000 rows make an Arrow batch and 4096 a Parquet read, however
    wide they are. All rows pass; only the pieces are smaller. Batches of scalar
    UDFs are not bounded by bytes; ``rows`` bounds theirs.
    """
    bounds = {"spark.sql.execution.arrow.maxBytesPerBatch": WIDE_BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": WIDE_READ_ROWS}
    if rows:
        bounds["spark.sql.execution.arrow.maxRecordsPerBatch"] = rows
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Used where one costly result feeds several consumers: it is computed once,
    lineage is cut, and a lost executor re-reads files instead of recomputing.
    ``group_bytes`` bounds the row groups, which a task holds whole.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/corpusmill-{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_few(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for few rows made by many tasks: they come in few files."""
    return stage(df.hint("rebalance"), name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the scan is planned in fewer tasks than cores.

    A small table in one file would be read by one task. Larger inputs have more
    scan tasks than cores and pass through untouched, so nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
