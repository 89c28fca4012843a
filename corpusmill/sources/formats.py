"""Supported file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import text_of

# Extension -> (kind, MIME type).
FORMATS = {
    ".docx": ("word", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".pdf": ("pdf", "application/pdf"),
    ".txt": ("text", "text/plain"),
    ".md": ("markdown", "text/markdown"),
    ".markdown": ("markdown", "text/markdown"),
    ".json": ("json", "application/json"),
    ".png": ("image", "image/png"),
    ".jpg": ("image", "image/jpeg"),
    ".jpeg": ("image", "image/jpeg"),
    ".webp": ("image", "image/webp"),
    ".tif": ("image", "image/tiff"),
    ".tiff": ("image", "image/tiff"),
    ".bmp": ("image", "image/bmp"),
    ".heic": ("image", "image/heic"),
}
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".json")
MAX_FILENAME = 180


def basename(path: Column) -> Column:
    name = F.regexp_extract(F.replace(text_of(path), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.when(extension(path) != "", F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def kind(path: Column) -> Column:
    """Format family, null for unsupported names."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for suffix, (family, _) in FORMATS.items():
        out = F.when(ext == suffix, F.lit(family)).otherwise(out)
    return out


def normalized_filename(path: Column) -> Column:
    """Base name, shortened to 180 characters with its extension kept."""
    name, ext = basename(path), extension(path)
    cut = F.concat(F.rtrim(F.substring(stem(path), F.lit(1), F.lit(MAX_FILENAME - 1) - F.length(ext))), ext)
    return F.when(F.length(name) > MAX_FILENAME, cut).otherwise(name)
