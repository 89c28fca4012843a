"""WARC archives as a Spark data source, and archiving of pages with revisits.

Every record is a gzip member of its own whose header carries the member's
length (the ``sl`` extra field), so a reader can inflate the record's headers
only and jump over a payload nobody asked for. Files are closed at a size
limit; a file is one input partition. A write lists its files in a manifest
when it commits, so files of lost or repeated tasks are never read.

Null html is an empty payload, a null url gives no target header, a null
page_id is written as no page header and ranks last. Control characters in urls
are percent-encoded. Rows that repeat the smallest page_id of a payload are all
responses. Empty tables give an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from corpusmill.session import broadcast_checked, ensure_checkpoint_dir

SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
REVISIT_BYTES = 100
FILE_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def open_folder(uri: str):
    """File system and path of a folder, by the URI's scheme."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None else None


# ---- one record ---------------------------------------------------------------


def record_bytes(row: dict, date: str) -> bytes:
    """Headers, block and end mark of one record, not yet compressed."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    block = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    page = row["page_id"]
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {row['refers_to']}"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that names its own length in an ``sl`` extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def records(stream, wanted, payloads: bool):
    """``(headers, payload)`` of the members whose headers ``wanted`` accepts.

    Only the headers of other members are inflated; payloads are left alone
    altogether unless ``payloads`` is set.
    """
    while head := stream.read(24):
        if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
            raise ValueError("damaged archive: no member starts here")
        left = struct.unpack("<I", head[16:20])[0] - 24
        inflater, text, packed = zlib.decompressobj(-15), b"", b""
        while b"\r\n\r\n" not in text:
            if not packed:
                packed = stream.read(min(left, 4096))
                left -= len(packed)
                if not packed:
                    raise ValueError("damaged archive: headers do not end")
            text += inflater.decompress(packed, 2048)
            packed = inflater.unconsumed_tail
        top, _, block = text.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        take = wanted(headers)
        payload = None
        if take and payloads:
            block += inflater.decompress(packed + stream.read(left)) + inflater.flush()
            left = 0
            payload = block[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]
        if left:
            stream.seek(left, 1)
        if take:
            yield headers, payload


# ---- the data source ------------------------------------------------------------


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    """With option ``pushdown``, equality filters on ``record_type``, ``page_id`` and ``payload_digest`` are taken over.

    Spark keeps a frame's reader once it has taken filters over, so a frame
    with that option is for one set of filters.
    """

    HEADERS = {"record_type": "warc-type", "page_id": "warc-page-id", "payload_digest": "warc-payload-digest"}

    def __init__(self, schema, folder, pushdown):
        self.columns, self.folder, self.pushdown, self.tests = schema.names, folder, pushdown, []
        self.schema = schema

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if self.pushdown and column in self.HEADERS and values is not None and None not in values:
                prefix = "sha256:" if column == "payload_digest" else ""
                self.tests.append((self.HEADERS[column], {f"{prefix}{v}" for v in values}))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, folder = open_folder(self.folder)
        files = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith("_manifest-"):
                with system.open_input_stream(info.path) as f:
                    files += [f"{folder}/{name}" for name in f.read().decode().split("\n") if name]
        return [ArchiveFile(path) for path in sorted(files)] or [ArchiveFile("")]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        system, _ = open_folder(self.folder)
        wanted = lambda h: all(h.get(name) in values for name, values in self.tests)
        values = {
            "page_id": lambda h, p: _number(h.get("warc-page-id")),
            "target_uri": lambda h, p: h.get("warc-target-uri"),
            "record_type": lambda h, p: h["warc-type"],
            "refers_to": lambda h, p: _number(h.get("warc-refers-to-page-id")),
            "payload_bytes": lambda h, p: int(h["warc-payload-length"]),
            "payload_digest": lambda h, p: h["warc-payload-digest"].removeprefix("sha256:"),
            "payload": lambda h, p: p,
        }
        makers = [values[c] for c in self.columns]
        rows, held = [], 0
        with system.open_input_file(partition.path) as stream:
            for headers, payload in records(stream, wanted, "payload" in self.columns):
                rows.append([make(headers, payload) for make in makers])
                held += 200 + len(payload or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder, date, file_bytes):
        self.folder, self.date, self.file_bytes = folder, date, file_bytes

    def write(self, iterator):
        system, folder = open_folder(self.folder)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                    data = member(record_bytes(row, self.date))
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        system, folder = open_folder(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(name for m in messages if m is not None for name in m.files).encode())

    def abort(self, messages):
        system, folder = open_folder(self.folder)
        for m in messages:
            for name in m.files if m is not None else []:
                system.delete_file(f"{folder}/{name}")


class WarcDataSource(DataSource):
    """``spark.read/write.format("warc").option("path", folder)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options["path"], self.options.get("pushdown") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("date", EPOCH), int(self.options.get("file_bytes", FILE_BYTES)))


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, where=None) -> DataFrame:
    """Records of a folder; without ``payloads`` only headers are inflated.

    ``where`` is judged on headers while reading, so that payloads of other
    records are jumped over.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark asks for it as the reader can take filters
    reader = spark.read.format("warc")
    if not payloads:
        reader = reader.schema(SCHEMA.rsplit(",", 1)[0])
    if where is None:
        return reader.load(folder)
    return reader.option("pushdown", "true").load(folder).where(where)


# ---- pages ----------------------------------------------------------------------


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with digest, record type and the page a revisit refers to.

    Only digests that occur more than once meet the pages again; that table is
    broadcast when it is measured to be small.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    first = (
        rows.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .where((F.col("copies") > 1) & F.col("first").isNotNull())
        .drop("copies")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(broadcast_checked(first), "payload_digest", "left").select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_pages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    pages.sparkSession.dataSource.register(WarcDataSource)
    page_records(pages, least).write.format("warc").option("file_bytes", str(file_bytes)).mode("append").save(folder)


def archive_digest(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES) -> DataFrame:
    """Archive ``pages``, read the archive back, one row per page.

    Size and digest of responses are taken from the payload that was read.
    """
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusmill-warc-{uuid.uuid4().hex}"
    write_pages(pages, folder, least)
    back = read_warc(spark, folder)
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
