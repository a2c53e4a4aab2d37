"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addonscope.llm import (
    anchors,
    bilinear,
    bond,
    langid,
    mixing,
    orchard,
    pseudonyms,
    pstable,
    runindex,
    secret_scan,
    tiling,
    tokencount,
    warc,
)
from addonscope.llm.common import read, row_key
from addonscope.session import work_dir

#: Key of the registered PII query; a production run passes its own secret.
PII_KEY = "example key, replace in production"


def training(docs: DataFrame) -> DataFrame:
    """Rows that the language models may learn from."""
    return docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull())


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    kinds = secret_scan.BASE
    base = F.expr(f"filter(spans, s -> s.kind < {len(kinds)})")
    counts = [
        F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("bigint").alias(f"n_{r.kind}") for i, r in enumerate(kinds)
    ]
    digest = F.sha2(secret_scan.joined(base, kinds).cast("binary"), 256)
    spans = secret_scan.joined(F.col("spans"), secret_scan.RULES)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), spans.alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's main language and its share of the text."""
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(training(docs))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item it contains most of, if any."""
    docs = read(spark, sf_dir, "documents")
    found = tiling.contamination(docs, read(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", row_key().alias("row"))
    return rows.join(found, "row", "left").select(
        "doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "n_tiles", "coverage"
    )


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of each kind were."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    moved = pseudonyms.pseudonymize(docs, PII_KEY)
    counts = [F.size(F.expr(f"filter(pii, k -> k = '{kind}')")).cast("bigint").alias(f"n_{kind}") for kind in pseudonyms.KINDS]
    return moved.select("doc_id", "text", *counts)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without the passages that documents with smaller ids hold."""
    found = runindex.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by word counts and by the model."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return bilinear.score(read(spark, sf_dir, "documents"), held_out)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links, component, and whether it stays."""
    return pstable.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its near-duplicates."""
    marked = anchors.near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has more than 512."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.limited(tokencount.token_counts(read(spark, sf_dir, "documents"), path))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the deduplicated archives says, read back from them."""
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    warc.write(warc.records(read(spark, sf_dir, "pages")), path)
    found = warc.resolve(warc.read(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code, its error, its label's error, and the digest of the codebooks."""
    return orchard.compress(read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; some labels are moved on by one first."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def _kind_sql(number: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: what lies between matches gives their places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
           "start" := CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT),
           size := length(m[i]), kept := length(v[i]) >= {rule.least}))) AS s
  FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM texts)"""


SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
spans AS (
  SELECT doc_id, kind, name, s."start" AS b,
         name || ':' || s."start" || ':' || (s."start" + s.size) AS span
  FROM found WHERE s.kept),
joined AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY b, kind) AS spans,
         string_agg(span, ',' ORDER BY b, kind) FILTER (WHERE kind < 3) AS base,
         count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k,
         count(*) FILTER (WHERE kind = 2) AS h
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS stop,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
           / CAST(sum(weight) OVER after AS DOUBLE) AS level
  FROM sources
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
shared AS (
  SELECT source, source_size, least(
    (SELECT arg_min(level, CAST(stop AS DOUBLE) / weight) FROM ranked
     WHERE level <= CAST(stop AS DOUBLE) / weight) * weight, CAST(stop AS DOUBLE)) AS target
  FROM ranked),
placed AS (
  SELECT doc_id, size, source_size, target,
         CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id
                              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent,
         CAST(floor(target + 0.5) AS BIGINT) AS quota
  FROM sized JOIN shared ON sized.source IS NOT DISTINCT FROM shared.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, quota - sent + size))
          + greatest(0, least(size, quota - source_size - sent + size))
          + greatest(0, least(size, quota - 2 * source_size - sent + size)) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN CAST(sent AS DOUBLE) / target END AS virtual_finish
FROM placed
"""

WARC_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           ((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')
           AS payload_digest
  FROM hashed),
ranked AS (
  SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS original
  FROM coded WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN original END AS refers_to
FROM ranked
"""

_USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE_SQL = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _assigned_sql(name: str, books: str) -> str:
    """Nearest entry and squared distance of every part: the least distance * 64 + index."""
    return f"""
{name} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(q) AS q, CAST(min(packed) % 64 AS INT) AS e, CAST(min(packed) // 64 AS BIGINT) AS d
  FROM (SELECT s.vec_id, s.label, s.p, s.q,
               list_sum(list_transform(list_zip(s.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.e AS packed
        FROM split s JOIN {books} b ON s.p = b.p)
  GROUP BY vec_id, label, p)"""


def _moved_sql(name: str, books: str, assigned: str) -> str:
    """Entries after one round: floored means position by position, unused ones as they were."""
    return f"""
{name} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.q, b.q) AS q
  FROM {books} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS q
    FROM (SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean
          FROM (SELECT p, e, unnest(q) AS x, unnest(range(len(q))) AS i FROM {assigned}) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


CODES_SQL = f"""
WITH whole AS (SELECT vec_id, label, {_WHOLE_SQL} AS v FROM embeddings WHERE {_USABLE_SQL}),
split AS MATERIALIZED (
  SELECT vec_id, label, CAST(p AS INT) AS p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS q
  FROM (SELECT *, unnest(range(16)) AS p FROM whole)),
books AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INT) AS e, q
  FROM split WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 64)),
{_assigned_sql("a1", "books")}, {_moved_sql("b1", "books", "a1")},
{_assigned_sql("a2", "b1")}, {_moved_sql("b2", "b1", "a2")},
{_assigned_sql("a3", "b2")},
codes AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a3 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM codes
"""

NEGATIVES_SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE_SQL}),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
 AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_repeats": op5_repeats,
    "op6_language_model": op6_language_model,
    "op7_mixing": op7_mixing,
    "op8_embeddings": op8_embeddings,
    "op9_simhash": op9_simhash,
    "op10_token_count": op10_token_count,
    "op11_warc": op11_warc,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_secret_scan": SECRETS_SQL,
    "op7_mixing": MIXING_SQL,
    "op11_warc": WARC_SQL,
    "op12_vector_codes": CODES_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
