"""Document catalogue, conversations, manifests and index versions."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusmill.functions.text import clean_spaces, strip, text_of

UNFILED = "uncategorized"
# File suffixes kept in object keys.
SAFE_SUFFIXES = (".docx", ".pdf", ".txt", ".md", ".markdown", ".json", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".heic")
# Log keys whose values are never written.
SENSITIVE_KEY = (
    r"(?i)(?:authorization|cookie|password|secret|token|api[_-]?key|credential|prompt|content|answer|document_text|message|exception|"
    r"question(?:$|[_-])|query(?:$|[_-])|text(?:$|[_-]))"
)


def source_counts(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Chunks per source; known sources without chunks show 0, unknown ones are kept."""
    counts = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    if sources is None:
        return counts
    return sources.select("source_id").distinct().join(counts, "source_id", "full_outer").select(
        "source_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )


def folder_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per folder; missing and dangling folders count as uncategorized."""
    known = folders.select("folder_id", "name")
    placed = documents.select("document_id", F.col("folder_id").alias("_f")).join(
        known.select(F.col("folder_id").alias("_f"), F.lit(True).alias("_k")), "_f", "left"
    )
    counts = placed.groupBy(F.when(F.col("_k"), F.col("_f")).otherwise(UNFILED).alias("folder_id")).agg(F.count("*").alias("n"))
    base = known.unionByName(
        folders.sparkSession.range(1).select(F.lit(UNFILED).alias("folder_id"), F.lit(UNFILED).alias("name"))
    )
    return base.join(counts, "folder_id", "left").select(
        "folder_id", "name", F.coalesce("n", F.lit(0)).alias("document_count"), (F.col("folder_id") == UNFILED).alias("system")
    ).orderBy(F.desc("system"), F.lower("name"))


def latest_version(versions: DataFrame, key: str = "document_id", number: str = "version_number") -> DataFrame:
    """Row with the highest version number; an aggregate, so hot documents combine early."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), number).alias("v")).select(key, "v.*")


def document_list(documents: DataFrame, versions: DataFrame, members: DataFrame) -> DataFrame:
    """Live documents with their latest version and whether the active index holds them."""
    latest = latest_version(versions)
    ready = members.filter("status = 'ready'").select("document_id", F.col("document_version_id").alias("member_version"))
    joined = documents.filter("deleted_at IS NULL").join(latest, "document_id", "left").join(ready, "document_id", "left")
    return joined.withColumn(
        "in_active_index", F.coalesce(F.col("member_version") == F.col("current_version_id"), F.lit(False))
    ).drop("member_version").orderBy("created_at", "document_id")


def conversation_list(conversations: DataFrame, messages: DataFrame, limit: int = 30) -> DataFrame:
    """Newest conversations with their message counts."""
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    return (
        conversations.join(counts, "conversation_id", "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
        .orderBy(F.desc("updated_at"), "conversation_id")
        .limit(max(1, int(limit)))
    )


def recent_messages(messages: DataFrame, limit: int = 10, order: tuple[str, ...] = ("created_at", "message_id")) -> DataFrame:
    """Last ``limit`` messages of every conversation in ascending position."""
    window = W.partitionBy("conversation_id").orderBy(*[F.desc(c) for c in order])
    last = messages.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= limit)
    position = W.partitionBy("conversation_id").orderBy(*order)
    return last.withColumn("position", F.row_number().over(position)).drop("_r")


def conversation_titles(messages: DataFrame, order: str = "message_id") -> DataFrame:
    """Title: opening of the first user message."""
    return messages.filter("role = 'user'").groupBy("conversation_id").agg(
        F.substring(clean_spaces(F.min_by("content", order)), 1, 80).alias("title")
    )


def messages_with_runs(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Messages with the answer run named in their metadata."""
    return messages.withColumn("run_id", F.get_json_object("metadata_json", "$.run_id")).join(runs, "run_id", "left")


def remember(memories: DataFrame, statements: DataFrame) -> DataFrame:
    """Upsert by content: the first creation time stays, the last update wins."""
    both = memories.select("content", "created_at", "updated_at").unionByName(statements.select("content", "created_at", "updated_at"))
    return both.groupBy("content").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def delete_conversations(conversations: DataFrame, messages: DataFrame, memories: DataFrame, gone: DataFrame):
    """Remove conversations and messages; memories stay and lose the reference."""
    ids = gone.select("conversation_id").distinct()
    kept_memories = memories.join(ids.withColumn("_gone", F.lit(True)), "conversation_id", "left").withColumn(
        "conversation_id", F.when(F.col("_gone").isNull(), F.col("conversation_id"))
    ).drop("_gone")
    return conversations.join(ids, "conversation_id", "left_anti"), messages.join(ids, "conversation_id", "left_anti"), kept_memories


def run_with_citations(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """Answer runs with their citations in rank order (a handful per run)."""
    grouped = citations.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_id", "content_sha256"))).alias("citations")
    )
    return runs.join(grouped, "run_id", "left")


def merge_points(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by point id, last sequence wins."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c != "point_id"]
    return both.groupBy("point_id").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("point_id", "v.*")


def content_key(extension: Column, payload: Column) -> Column:
    """Content address: DOCX by bytes, other formats by extension and bytes."""
    salted = F.concat(F.encode(F.lower(extension), "UTF-8"), F.unhex(F.lit("00")), payload)
    digest = F.when(F.lower(extension) == ".docx", F.sha2(payload, 256)).otherwise(F.sha2(salted, 256))
    return F.concat(F.lit("upload-"), F.substring(digest, 1, 20))


def new_documents(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """First upload of every content not in the catalogue yet.

    ``uploads(source_id, uploaded_at, ...)``; copies collapse in a pre-aggregated
    ``min_by``, so a third of all uploads may be one document.
    """
    rest = [c for c in uploads.columns if c != "source_id"]
    order = F.struct("uploaded_at", *[c for c in rest if c in ("upload_id",)])
    first = uploads.groupBy("source_id").agg(F.min_by(F.struct(*rest), order).alias("v")).select("source_id", "v.*")
    return first.join(known.select("source_id").distinct(), "source_id", "left_anti")


def manifest_digest(entries: DataFrame, keys: tuple[str, ...] = ("tenant_id", "kb_id", "index_version_id")) -> DataFrame:
    """Order-free digest of index entries per index version, with duplicate checks.

    Entry digests are summed per 32-bit lane (map-side combined) and the sums are
    hashed, so an index of any size is never gathered in one place. Two stores
    agree exactly when counts and digests agree.
    """
    fields = ("point_id", "chunk_id", "chunk_record_id", "document_id", "document_version_id", "content_sha256")
    line = F.sha2(F.concat_ws("\u0000", *[strip(text_of(f)) for f in fields]), 256)
    hashed = entries.withColumn("_h", line)
    lanes = [F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    complete = F.lit(True)
    for f in fields:
        complete = complete & (strip(text_of(f)) != "")
    grouped = hashed.groupBy(*keys).agg(
        F.count("*").alias("entry_count"),
        F.min(complete & F.col("content_sha256").rlike("^[0-9a-fA-F]{64}$")).alias("well_formed"),
        *lanes,
    )
    doubled = None
    for f in ("point_id", "chunk_id", "chunk_record_id"):
        part = entries.groupBy(*keys, f).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
        doubled = part if doubled is None else doubled.unionByName(part)
    doubled = doubled.distinct().withColumn("_dup", F.lit(True))
    digest = F.sha2(F.concat_ws("|", *[F.col(f"p{i}").cast("string") for i in range(8)]), 256)
    return grouped.join(doubled, list(keys), "left").select(
        *keys, "entry_count", digest.alias("digest"), (F.col("well_formed") & F.col("_dup").isNull()).alias("valid")
    )


def validate_index(expected: DataFrame, members: DataFrame, rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts and digests of manifest, row store and vector store must agree.

    ``expected(index_version_id, expected_documents, expected_chunks, digest)``.
    """
    keys = ("index_version_id",)
    docs = members.filter("status = 'ready'").groupBy(*keys).agg(F.count("*").alias("documents"))
    a = manifest_digest(rows, keys).select(*keys, F.col("entry_count").alias("row_chunks"), F.col("digest").alias("row_digest"), F.col("valid").alias("row_valid"))
    b = manifest_digest(vectors, keys).select(*keys, F.col("entry_count").alias("vector_chunks"), F.col("digest").alias("vector_digest"))
    joined = expected.join(docs, list(keys), "left").join(a, list(keys), "left").join(b, list(keys), "left")
    ok = (
        (F.col("documents") == F.col("expected_documents"))
        & (F.col("row_chunks") == F.col("expected_chunks"))
        & (F.col("vector_chunks") == F.col("expected_chunks"))
        & (F.col("row_digest") == F.col("vector_digest"))
        & (F.col("digest") == F.col("row_digest"))
        & F.col("row_valid")
    )
    return joined.withColumn("ready", F.coalesce(ok, F.lit(False)))


def publish(current: DataFrame, request: DataFrame) -> DataFrame:
    """Compare-and-set of the active index per knowledge base.

    ``current(kb_id, active_index_version_id, generation)``,
    ``request(kb_id, target, expected_active, expected_generation)``. The change
    applies only when id and generation are still the expected ones.
    """
    j = current.join(request, "kb_id", "left")
    same = (F.coalesce("active_index_version_id", F.lit("")) == F.coalesce("expected_active", F.lit(""))) & (
        F.col("generation") == F.col("expected_generation")
    )
    applies = F.col("target").isNotNull() & F.coalesce(same, F.lit(False))
    return j.select(
        "kb_id",
        F.when(applies, F.col("target")).otherwise(F.col("active_index_version_id")).alias("active_index_version_id"),
        (F.col("generation") + F.when(applies, 1).otherwise(0)).alias("generation"),
        F.when(applies, F.col("active_index_version_id")).alias("retired_index_version_id"),
        applies.alias("published"),
    )


def object_key(tenant: Column, kb: Column, document: Column, version: Column, filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))
    return F.concat_ws(
        "/", F.lit("tenants"), tenant, F.lit("knowledge-bases"), kb, F.lit("documents"), document, F.lit("versions"), version,
        F.concat(F.lit("original"), F.when(suffix.isin(*SAFE_SUFFIXES), suffix).otherwise(".bin")),
    )


@F.pandas_udf(T.StringType())
def point_id(tenant: pd.Series, kb: pd.Series, index_version: pd.Series, chunk_id: pd.Series) -> pd.Series:
    """Stable UUID of a chunk inside its index version."""
    return pd.Series([str(uuid.uuid5(uuid.NAMESPACE_URL, "/".join(p))) for p in zip(tenant, kb, index_version, chunk_id)])


def folder_name(name: Column) -> Column:
    """Tidy folder name, null when empty or longer than 80 characters."""
    tidy = clean_spaces(F.regexp_replace(text_of(name), r"[\x00-\x1f\x7f]", ""))
    return F.when((tidy != "") & (F.length(tidy) <= 80), tidy)


def redact(values: Column) -> Column:
    """Map of log values with sensitive entries replaced by their length."""
    return F.transform_values(
        values,
        lambda key, value: F.when(
            key.rlike(SENSITIVE_KEY) & value.isNotNull(),
            F.concat(F.lit('{"redacted":true,"length":'), F.length(value).cast("string"), F.lit("}")),
        ).otherwise(value),
    )


def provision(existing: DataFrame, requested: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Idempotent upsert of identities: known keys stay, new ones are added once."""
    fresh = requested.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def next_versions(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Accepted uploads get the next version number of their document.

    An upload counts only if unexpired and its size, digest and type are as
    reserved; several uploads of one document number on in time order.
    """
    top = versions.groupBy("document_id").agg(F.max("version_number").alias("_top"))
    good = uploads.filter(
        "observed_at < expires_at AND observed_size = expected_size AND lower(observed_sha256) = lower(expected_sha256) AND observed_mime = expected_mime"
    )
    order = W.partitionBy("document_id").orderBy("observed_at", "upload_id")
    return good.join(top, "document_id", "left").withColumn(
        "version_number", F.coalesce("_top", F.lit(0)) + F.row_number().over(order)
    ).drop("_top")


def tombstones(documents: DataFrame, requests: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft deletes and the outbox of object keys; a repeated request adds nothing."""
    first = requests.groupBy("document_id").agg(F.min_by(F.struct("idempotency_key", "requested_at"), F.struct("requested_at", "idempotency_key")).alias("r"))
    marked = documents.join(first, "document_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", F.col("r.requested_at"))).drop("r")
    live = documents.filter("deleted_at IS NULL").select("document_id").join(first, "document_id")
    keys = versions.groupBy("document_id").agg(F.array_sort(F.collect_set("object_key")).alias("object_keys"))
    outbox = live.join(keys, "document_id", "left").select(
        F.sha2(F.concat_ws("/", "document_id", "r.idempotency_key"), 256).alias("outbox_id"), "document_id", "object_keys",
        F.lit("pending").alias("state"), F.lit(0).alias("attempt"),
    )
    return marked, outbox


def valid_profile_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", str(name or "")))


def bytes_digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
