"""Corpus scans: text files and archives as ``files`` rows.

``files``: ``repo, path, name, type, content, size`` with one row per
``(repo, path)``.  The first folder under the root is the repository.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addonscope.fixed_values import ACCEPTED_EXTENSIONS, ARCHIVE_EXTENSION
from addonscope.functions import text as T

FILES = "repo STRING, path STRING, name STRING, type STRING, content STRING, size BIGINT"


def _any_case_glob(extensions: list[str]) -> str:
    alternatives = ["".join(f"[{c}{c.upper()}]" for c in ext) for ext in extensions]
    return "*.{" + ",".join(alternatives) + "}"


def _located(root: str) -> tuple[Column, Column]:
    """Repository and path inside it, from the file location below ``root``."""
    location = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    plain = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    start = F.locate(plain + "/", location) + len(plain) + 1
    relative = F.regexp_replace(F.substr(location, start), "^/+", "")
    in_repo = F.contains(relative, F.lit("/"))
    repo = F.when(in_repo, F.substring_index(relative, "/", 1)).otherwise("")
    path = F.when(in_repo, F.regexp_replace(relative, "^[^/]*/", "")).otherwise(relative)
    return repo, path


def _within(size: Column, max_bytes: int | None) -> Column:
    return F.lit(True) if max_bytes is None else size <= max_bytes


def scan_corpus(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Text files of the accepted kinds, each one row; with ``max_bytes`` only up to that size.

    Extension and size are tested on the file listing, before any text is read.
    """
    repo, path = _located(root)
    return (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case_glob(ACCEPTED_EXTENSIONS))
        .load(root)
        .where(_within(F.col("_metadata.file_size"), max_bytes))
        .select(
            repo.alias("repo"),
            path.alias("path"),
            F.col("value").alias("content"),
            F.col("_metadata.file_size").alias("size"),
        )
        .transform(classify)
    )


def rejected_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files a scan leaves out, as parse errors.  Only the listing is read."""
    repo, path = _located(root)
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(repo.alias("repo"), path.alias("path"), F.col("length").alias("size"))
    )
    known = T.extension(F.col("path")).isin([*ACCEPTED_EXTENSIONS, ARCHIVE_EXTENSION])
    message = F.when(~known, "unsupported format").when(
        ~_within(F.col("size"), max_bytes), f"file larger than {max_bytes} bytes"
    )
    return (
        listing.withColumn("message", message)
        .where(F.col("message").isNotNull())
        .select(
            "repo",
            "path",
            F.lit(None).cast("int").alias("line"),
            "message",
            F.lit("rejected_file").alias("type"),
        )
    )


#: Entries of archives that are handed on together: their text, and how many.
_ENTRY_BYTES, _ENTRY_ROWS = 8 << 20, 4096


def _expand(max_bytes: int | None):
    """Entries of archives: their text, or why there is none."""

    def entries(raw: bytes) -> Iterator[tuple[str, str | None, int, str | None]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            yield "", None, len(raw), "not a readable archive"
            return
        with archive:
            for info in archive.infolist():
                ext = info.filename.rsplit(".", 1)[-1].lower()
                if info.is_dir() or ext not in ACCEPTED_EXTENSIONS:
                    continue
                if max_bytes is not None and info.file_size > max_bytes:
                    yield info.filename, None, info.file_size, f"file larger than {max_bytes} bytes"
                    continue
                try:
                    body = archive.read(info).decode("utf-8", "replace")
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                    yield info.filename, None, info.file_size, f"unreadable entry: {e}"
                    continue
                yield info.filename, body, info.file_size, None

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["repo", "archive", "path", "content", "size", "problem"])

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for repo, path, raw in zip(batch["repo"], batch["path"], batch["content"]):
                for name, body, size, problem in entries(raw):
                    rows.append((repo, path, name, body, size, problem))
                    held += len(body or "")
                    if held >= _ENTRY_BYTES or len(rows) >= _ENTRY_ROWS:
                        yield table(rows)
                        rows, held = [], 0
        yield table(rows)

    return expand


def archives_at(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(repo, path, content) of the zip archives under ``root``."""
    repo, path = _located(root)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case_glob([ARCHIVE_EXTENSION]))
        .load(root)
        .where(_within(F.col("length"), max_bytes))
        .select(repo.alias("repo"), path.alias("path"), "content")
    )


def _archive_entries(archives: DataFrame, max_bytes: int | None) -> DataFrame:
    entries = archives.select("repo", "path", "content").mapInPandas(
        _expand(max_bytes),
        "repo STRING, archive STRING, path STRING, content STRING, size BIGINT, problem STRING",
    )
    own = F.when(F.col("repo") == "", F.col("archive")).otherwise(F.col("repo"))
    return entries.withColumn("repo", own)


def unpack(archives: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text files inside zip archives (repo, path, content).

    Folders, nested archives and other kinds are skipped.  Where two entries
    share a path, one is kept.  An archive without a repository folder is its
    own repository.  What cannot be read is in ``unpack_errors``.
    """
    entries = _archive_entries(archives, max_bytes).where("problem IS NULL")
    return unique_files(entries.drop("archive", "problem").transform(classify))


def unpack_errors(archives: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Archives and entries that ``unpack`` leaves out, as parse errors."""
    inside = F.when(F.col("path") == "", F.col("archive")).otherwise(
        F.concat_ws("/", "archive", "path")
    )
    return (
        _archive_entries(archives, max_bytes)
        .where("problem IS NOT NULL")
        .select(
            "repo",
            inside.alias("path"),
            F.lit(None).cast("int").alias("line"),
            F.col("problem").alias("message"),
            F.lit("archive_error").alias("type"),
        )
    )


def scan_archives(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Text files inside the zip archives under ``root``: see ``unpack``."""
    return unpack(archives_at(spark, root, max_bytes), max_bytes)


def archive_errors(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """What ``scan_archives`` leaves out: see ``unpack_errors``."""
    return unpack_errors(archives_at(spark, root, max_bytes), max_bytes)


def classify(files: DataFrame) -> DataFrame:
    """Adds normalized path, name and type; a given type wins over the extension."""
    path = T.normalize_path(F.col("path"))
    by_name = T.file_type(T.base_name(path))
    given = (
        F.coalesce(F.nullif(F.col("type"), F.lit("")), by_name)
        if "type" in files.columns
        else by_name
    )
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("long")
    return files.select(
        "repo",
        path.alias("path"),
        T.base_name(path).alias("name"),
        given.alias("type"),
        "content",
        size.alias("size"),
    )


def unique_files(files: DataFrame) -> DataFrame:
    """One row per ``(repo, path)``.

    Most copies already leave before the shuffle (the rank limit is applied on
    both sides of it), and the result is partitioned the way line operators need.
    """
    copies = Window.partitionBy("repo", "path").orderBy(F.xxhash64("content"))
    return (
        files.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")
    )
