"""Corpus of source files on disk: recursive scan, strict UTF-8, labels from the directory layout."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import configure

OTHER = "other"
# Suffixes of the languages in the corpus.
LANGUAGES = {
    "py": "python", "php": "php", "js": "javascript", "ts": "typescript", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "java": "java", "rb": "ruby", "go": "go", "rs": "rust", "html": "html", "sql": "sql",
}


def _below(path: Column, root: str) -> Column:
    """``path``, as Spark spells it, without its scheme and host and without ``root``."""
    own = urlsplit(root).path if "://" in root else root.removeprefix("file:")
    own = (own if own.startswith("/") else os.path.abspath(own)).rstrip("/")
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(plain, len(os.path.normpath(own) if own else "") + 2, 2_147_483_647)


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """Files below ``root`` as ``(path, text, valid)``.

    ``path`` is relative to the root. A file that is not UTF-8 keeps its row with a null text. Line
    ends are normalised the way a text-mode read does.
    """
    configure(spark)
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "content")
    )
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    return raw.select(
        _below(F.col("path"), root).alias("path"),
        F.when(valid, text).alias("text"),
        valid.alias("valid"),
    )


def path_order(path: Column) -> Column:
    """Sort key of paths: by their parts, so a directory sorts before its longer-named sibling."""
    return F.split(path, "/")


def category_of(path: Column) -> Column:
    """Category of a labelled file: its parent directory; null at the root."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def language_of(path: Column) -> Column:
    """Language by suffix; unknown or missing suffixes are ``other``."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(v) for item in LANGUAGES.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit(OTHER))
