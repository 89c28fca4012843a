"""File checks before extraction."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import text_of
from corpusmill.sources.formats import FORMATS

# Instruction patterns that must not hide in documents.
INJECTION_PATTERNS = {
    "ignore_previous_instructions": r"(?isU)ignore\s+(all\s+)?previous\s+instructions",
    "system_prompt_exfiltration": r"(?isU)(show|reveal|print|output).{0,40}system\s+prompt",
    "tool_execution_instruction": r"(?isU)(execute|run|call).{0,30}(tool|command|shell)",
    "chinese_instruction_override": r"(?isU)忽略.{0,12}(先前|以上|原本).{0,12}(指令|規則)",
}

# Leading bytes of the binary formats, as hex.
SIGNATURES = {
    ".pdf": ("255044462D",),
    ".png": ("89504E470D0A1A0A",),
    ".bmp": ("424D",),
    ".tif": ("49492A00", "4D4D002A"),
    ".tiff": ("49492A00", "4D4D002A"),
    ".docx": ("504B",),
}


def injection_findings(text: Column) -> Column:
    """Names of the instruction patterns found in a text."""
    body = text_of(text)
    return F.filter(
        F.array(*[F.when(body.rlike(pattern), F.lit(name)) for name, pattern in INJECTION_PATTERNS.items()]), lambda x: x.isNotNull()
    )


def signature_ok(extension: Column, payload: Column) -> Column:
    """Magic bytes agree with the extension; text formats have none."""
    head = F.hex(F.substring(payload, 1, 32))
    tail = F.hex(F.substring(payload, -2, 2))
    ok = F.lit(True)
    for suffix, heads in SIGNATURES.items():
        matches = F.lit(False)
        for h in heads:
            matches = matches | head.startswith(h)
        ok = F.when(extension == suffix, matches).otherwise(ok)
    ok = F.when(extension.isin(".jpg", ".jpeg"), head.startswith("FFD8FF") & (tail == "FFD9")).otherwise(ok)
    ok = F.when(extension == ".webp", head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")).otherwise(ok)
    return F.when(extension == ".heic", head.contains("66747970")).otherwise(ok)


@F.pandas_udf(T.StringType())
def docx_problem(payloads: pd.Series, max_bytes: pd.Series) -> pd.Series:
    """Why a DOCX container is unsafe; null when it is fine."""

    def check(payload: bytes, limit: int):
        try:
            members = zipfile.ZipFile(io.BytesIO(payload)).infolist()
        except zipfile.BadZipFile:
            return "invalid container"
        names = {m.filename.replace("\\", "/") for m in members}
        size, packed = sum(m.file_size for m in members), sum(max(1, m.compress_size) for m in members)
        if any(n.startswith("/") or any(part in ("", ".", "..") for part in n.split("/")) for n in names):
            return "unsafe path"
        if size > limit or size / max(1, packed) > 100:
            return "expands too far"
        return None if {"[Content_Types].xml", "word/document.xml"} <= names else "required parts missing"

    return pd.Series([check(p, int(n)) for p, n in zip(payloads, max_bytes)])


def inspect_files(files: DataFrame, max_uncompressed: int = 250 * 1024 * 1024) -> DataFrame:
    """Add ``problem`` (null when accepted) to ``files(filename, extension, mime, content)``."""
    kinds = files.sparkSession.createDataFrame([(e, m) for e, (_, m) in FORMATS.items()], "extension string, expected_mime string")
    checked = files.join(F.broadcast(kinds), "extension", "left")
    is_docx = F.col("extension") == ".docx"
    problem = (
        F.when(F.col("expected_mime").isNull(), "unsupported extension")
        .when(F.lower("mime") != F.col("expected_mime"), "declared type differs")
        .when(F.length("content") == 0, "empty")
        .when(~signature_ok(F.col("extension"), F.col("content")), "signature invalid")
    )
    checked = checked.withColumn("problem", problem)
    safe = checked.filter(is_docx & F.col("problem").isNull()).withColumn("problem", docx_problem(F.col("content"), F.lit(max_uncompressed)))
    return checked.filter(~is_docx | F.col("problem").isNotNull()).unionByName(safe).drop("expected_mime")
