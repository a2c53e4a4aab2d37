"""Queries over what a scan leaves out and over archives."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from addonscope.session import work_dir
from addonscope.sources import corpus as sources
from workload.registry import Corpus, query

_LARGEST = 100_000


@query("rejected_files", f"""
  WITH sz AS (SELECT source, sum(strlen(coalesce(text, '')) + 1) AS n FROM documents GROUP BY source)
  SELECT 'source=' || source AS repo, 'unsupported format' AS message, 'rejected_file' AS type, 1 AS n FROM sz
  UNION ALL
  SELECT 'source=' || source, 'file larger than {_LARGEST} bytes', 'rejected_file', 1 FROM sz WHERE n > {_LARGEST}
""")
def rejected_files(c: Corpus):
    """The documents of every source as one file of an accepted kind and one of another."""
    root = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/listing-{uuid.uuid4().hex}"
    rows = c.table("documents").select(F.coalesce("text", F.lit("")).alias("text"), "source").repartition("source")
    rows.write.partitionBy("source").text(f"{root}/plain")
    rows.write.partitionBy("source").json(f"{root}/other")
    found = sources.rejected_files(c.spark, f"{root}/plain", _LARGEST).unionByName(
        sources.rejected_files(c.spark, f"{root}/other", _LARGEST)
    )
    return found.groupBy("repo", "message", "type").agg(F.count("*").alias("n"))


#: Documents of an archive.
_BATCH = 50
_ENDINGS = ["py", "XML", "exe", "txt"]


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("folder/", "")
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            archive.writestr(f"d{doc_id % 7}/doc_{doc_id}.{_ENDINGS[doc_id % 4]}", text or "")
    content = raw.getvalue()
    at = int(rows["doc_id"].min()) // _BATCH
    if at % 5 == 4:
        content = content[: len(content) // 2]
    return pd.DataFrame({"repo": [""], "path": [f"batch_{at}.zip"], "content": [content]})


def _archives(c: Corpus):
    """The documents in archives, every fifth of them cut short."""
    rows = c.table("documents").select("doc_id", "text").groupBy(F.floor(F.col("doc_id") / _BATCH))
    return c.kept("archives", lambda: rows.applyInPandas(_zipped, "repo string, path string, content binary"))


_ENTRIES = f"""
  SELECT 'batch_' || CAST(doc_id // {_BATCH} AS VARCHAR) || '.zip' AS repo, doc_id // {_BATCH} AS batch,
         'd' || CAST(doc_id % 7 AS VARCHAR) || '/doc_' || CAST(doc_id AS VARCHAR) || '.'
           || CASE doc_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'XML' WHEN 2 THEN 'exe' ELSE 'txt' END AS path,
         CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'xml' WHEN 3 THEN 'other' END AS type,
         coalesce(text, '') AS content, strlen(coalesce(text, '')) AS size
  FROM documents
"""


@query("archive_files", f"""
  SELECT repo, path, type, md5(content) AS content, size
  FROM ({_ENTRIES}) e WHERE batch % 5 <> 4 AND type IS NOT NULL AND size <= 20000
""")
def archive_files(c: Corpus):
    """Entries of the readable archives up to a size."""
    files = sources.unpack(_archives(c), 20_000)
    return files.select("repo", "path", "type", F.md5(F.col("content").cast("binary")).alias("content"), "size")


@query("archive_errors", f"""
  SELECT repo, repo || '/' || path AS path, 'file larger than 20000 bytes' AS message, 'archive_error' AS type
  FROM ({_ENTRIES}) e WHERE batch % 5 <> 4 AND type IS NOT NULL AND size > 20000
  UNION ALL
  SELECT DISTINCT repo, repo, 'not a readable archive', 'archive_error' FROM ({_ENTRIES}) e WHERE batch % 5 = 4
""")
def archive_errors(c: Corpus):
    """Entries that are too large, and archives that cannot be read."""
    return sources.unpack_errors(_archives(c), 20_000).select("repo", "path", "message", "type")
