"""Queries over the review store and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from addonscope.fixed_values import AUDIT_PAGE
from addonscope.operators import python_source, review
from addonscope.session import work_dir
from addonscope.sources import corpus as sources
from addonscope.streaming import events as streams
from workload.registry import Corpus, query

# Customers with a balance are known users; every customer logs in once more.
_ROLE = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Admin' WHEN 'BUILDING' THEN 'Reviewer' "
         "WHEN 'FURNITURE' THEN 'Developer' ELSE 'Viewer' END")


def _users(c: Corpus):
    return c.table("customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("external_id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@old")).alias("email"),
        F.lit("old.png").alias("avatar"),
        F.expr(_ROLE).alias("role"),
    )


def _logins(c: Corpus):
    return c.table("customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("external_id"),
        F.concat(F.lit("New "), "c_name").alias("name"),
        F.when(F.col("c_nationkey") > 12, F.concat("c_name", F.lit("@new"))).alias("email"),
        F.lit("").alias("avatar"),
        F.col("c_custkey").alias("seq"),
    )


_UPSERT = f"""
  SELECT c_custkey AS id, 'u' || CAST(c_custkey AS STRING) AS external_id,
         'New ' || c_name AS name,
         CASE WHEN c_nationkey > 12 THEN c_name || '@new' ELSE c_name || '@old' END AS email,
         'old.png' AS avatar, {_ROLE} AS role
  FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT (SELECT max(c_custkey) FROM customer WHERE c_acctbal >= 0)
           + row_number() OVER (ORDER BY c_custkey),
         'u' || CAST(c_custkey AS STRING), 'New ' || c_name,
         CASE WHEN c_nationkey > 12 THEN c_name || '@new' END, NULL, 'Viewer'
  FROM customer WHERE c_acctbal < 0
"""


@query("upsert_users", _UPSERT)
def upsert_users(c: Corpus):
    return review.upsert_users(_users(c), _logins(c))


@query("first_users", """
  SELECT row_number() OVER (ORDER BY c_custkey) AS id,
         'u' || CAST(c_custkey AS STRING) AS external_id,
         CASE WHEN row_number() OVER (ORDER BY c_custkey) = 1 THEN 'Admin' ELSE 'Viewer' END AS role
  FROM customer
""")
def first_users(c: Corpus):
    """Logins into an empty store: the first user becomes admin."""
    nobody = c.spark.createDataFrame([], review.USERS)
    return review.upsert_users(nobody, _logins(c)).select("id", "external_id", "role")


def _changes(c: Corpus):
    return c.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") < 5, "Owner")
        .when(F.col("c_nationkey") < 15, "Reviewer")
        .otherwise("Admin")
        .alias("role"),
    )


_NEW_ROLE = ("CASE WHEN c_nationkey < 5 THEN 'Owner' WHEN c_nationkey < 15 THEN 'Reviewer' "
             "ELSE 'Admin' END")


@query("change_roles", f"""
  SELECT c_custkey AS id,
         CASE WHEN c_nationkey < 5 THEN {_ROLE} ELSE {_NEW_ROLE} END AS role
  FROM customer WHERE c_acctbal >= 0
""")
def change_roles(c: Corpus):
    after, _, _ = review.change_roles(_users(c), _changes(c), 1, "root")
    return after.select("id", "role")


@query("role_audit", f"""
  SELECT 'Modify User Role' AS action, 'Changed user ID ' || CAST(c_custkey AS STRING) || ' ('
         || c_name || ') role from ' || {_ROLE} || ' to ' || {_NEW_ROLE} AS details
  FROM customer WHERE c_acctbal >= 0 AND c_nationkey >= 5
""")
def role_audit(c: Corpus):
    _, audit, _ = review.change_roles(_users(c), _changes(c), 1, "root")
    return audit.select("action", "details")


@query("refused_roles", """
  SELECT c_custkey AS id, 'Invalid role' AS reason FROM customer WHERE c_nationkey < 5
  UNION ALL
  SELECT c_custkey, 'User not found' FROM customer WHERE c_nationkey >= 5 AND c_acctbal < 0
""")
def refused_roles(c: Corpus):
    _, _, refused = review.change_roles(_users(c), _changes(c), 1, "root")
    return refused.select("id", "reason")


def _audit(c: Corpus):
    """Orders as audit entries; orders without a priority word have no action."""
    return review.audit_rows(
        c.table("orders"),
        F.col("o_custkey"),
        F.concat(F.lit("user "), F.col("o_custkey").cast("string")),
        F.substring_index("o_orderpriority", "-", -1),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
        F.col("o_orderdate"),
    )


_AUDIT = """
  SELECT o_orderdate AS timestamp, o_custkey AS user_id,
         'user ' || CAST(o_custkey AS STRING) AS user_name,
         regexp_extract(o_orderpriority, '[^-]*$') AS action,
         'order ' || CAST(o_orderkey AS STRING) AS details
  FROM orders
"""


@query("newest_audit", f"""
  SELECT * FROM ({_AUDIT}) q
  ORDER BY timestamp DESC, user_id, user_name, action, details LIMIT 200
""")
def newest_audit(c: Corpus):
    return review.newest_audit(_audit(c), AUDIT_PAGE)


@query("append_audit", f"SELECT action, count(*) AS n FROM (({_AUDIT}) UNION ALL ({_AUDIT})) q GROUP BY action")
def append_audit(c: Corpus):
    """The audit log after two appends, read back."""
    path = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/audit-{uuid.uuid4().hex}"
    review.append_table(_audit(c), path)
    review.append_table(_audit(c), path)
    return review.scan_table(c.spark, path, review.AUDIT).groupBy("action").agg(
        F.count("*").alias("n")
    )


def _comments(c: Corpus):
    """Conversation turns as comments; system turns come in blank."""
    return c.table("conversations").select(
        F.concat(F.lit("issue_"), F.col("conv_id").cast("string")).alias("issue_id"),
        F.col("turn").cast("bigint").alias("user_id"),
        F.col("role").alias("user_name"),
        F.lit(None).cast("string").alias("user_avatar"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("turn")).alias("timestamp"),
        F.when(F.col("role") == "system", " \n\t").otherwise(F.col("text")).alias("comment_text"),
    )


@query("valid_comments", """
  SELECT 'issue_' || CAST(conv_id AS STRING) AS issue_id, turn AS user_id, text AS comment_text
  FROM conversations
  WHERE role <> 'system' AND length(regexp_replace(text, '\\s', '', 'g')) > 0
""")
def valid_comments(c: Corpus):
    return review.valid_comments(_comments(c)).select("issue_id", "user_id", "comment_text")


@query("comment_audit", """
  SELECT 'Added review comment on issue issue_' || CAST(conv_id AS STRING) AS details, count(*) AS n
  FROM conversations
  WHERE role <> 'system' AND length(regexp_replace(text, '\\s', '', 'g')) > 0 GROUP BY conv_id
""")
def comment_audit(c: Corpus):
    return review.comment_audit(_comments(c)).groupBy("details").agg(F.count("*").alias("n"))


@query("comments_of_issues", """
  SELECT 'issue_' || CAST(d.doc_id AS STRING) AS issue_id,
         CASE WHEN l.toxic = 1 THEN 'TOX' ELSE 'OK' END AS rule_id, c.turn AS user_id, c.role AS user_name
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN conversations c ON c.conv_id = d.doc_id
""")
def comments_of_issues(c: Corpus):
    """Labelled documents as issues, with the comments on them."""
    issues = c.table("documents").join(c.table("labels"), "doc_id").select(
        F.concat(F.lit("issue_"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("toxic") == 1, "TOX").otherwise("OK").alias("rule_id"),
    )
    return review.comments_of(issues, _comments(c)).select(
        "issue_id", "rule_id", "user_id", "user_name"
    )


@query("issue_comments", """
  SELECT turn AS user_id, role AS user_name,
         row_number() OVER (ORDER BY turn) AS pos
  FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)
""")
def issue_comments(c: Corpus):
    """Comments of the first conversation in reading order."""
    comments = _comments(c)
    first = c.table("conversations").agg(F.min("conv_id")).first()[0]
    return review.dense_numbers(
        review.issue_comments(comments, f"issue_{first}"), ["timestamp"]
    ).select("user_id", "user_name", F.col("number").alias("pos"))


@query("users_by_name", f"""
  SELECT c_custkey AS id, c_name AS name, c_name || '@old' AS email, 'old.png' AS avatar,
         {_ROLE} AS role
  FROM customer WHERE c_acctbal >= 0
""")
def users_by_name(c: Corpus):
    return review.users_by_name(_users(c))


@query("total_users", "SELECT count(*) AS total_users FROM customer WHERE c_acctbal >= 0")
def total_users(c: Corpus):
    return review.total_users(_users(c))


# --------------------------------------------------------------------- streams


def _push_events(c: Corpus):
    """Events as push notifications; parts are missing for some kinds."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return c.table("events").select(
        F.when(kind != "error", F.struct(F.concat(F.lit("org/repo"), user).alias("full_name"))
               ).alias("repository"),
        F.when(kind != "view", F.concat(F.lit("refs/heads/"), kind)).alias("ref"),
        F.when(kind != "click", F.struct(F.concat(F.lit("commit "), "props").alias("message"))
               ).alias("head_commit"),
    )


_PUSH = """
  SELECT 'Git Push Triggered' AS action, 'Repository: '
         || CASE WHEN event_type = 'error' THEN 'Unknown repo'
                 ELSE 'org/repo' || CAST(user_id AS STRING) END
         || ', Branch: ' || CASE WHEN event_type = 'view' THEN 'main' ELSE event_type END
         || ', Head Commit: ' || CASE WHEN event_type = 'click' THEN 'No message'
                                      ELSE 'commit ' || props END AS details
  FROM events
"""


@query("push_events", _PUSH)
def push_events(c: Corpus):
    return streams.push_events_to_audit(_push_events(c)).select("action", "details")


@query("push_event_stream", _PUSH)
def push_event_stream(c: Corpus):
    """The same events as JSON files through the stream, the audit log read back."""
    base = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/push-{uuid.uuid4().hex}"
    _push_events(c).write.json(f"{base}/in")
    streams.stream_push_events(
        c.spark, f"{base}/in", f"{base}/audit", f"{base}/state"
    ).awaitTermination()
    return review.scan_table(c.spark, f"{base}/audit").select("action", "details")


@query("incremental_scan", """
  SELECT count(*) AS n FROM part WHERE p_size % 3 <> 0
""")
def incremental_scan(c: Corpus):
    """Many2one findings of the whole corpus, arriving as a stream of files."""
    base = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/scan-{uuid.uuid4().hex}"
    c.files.where("name LIKE '%.py'").write.parquet(f"{base}/in")
    arrivals = c.spark.readStream.schema(c.files.schema).parquet(f"{base}/in")
    streams.incremental_scan(
        arrivals, lambda: c.spark.read.schema(c.files.schema).parquet(f"{base}/in"),
        f"{base}/out", f"{base}/state",
    ).awaitTermination()
    found = streams.current_findings(c.spark, f"{base}/out")
    return found.where("rule_id = 'DAT001' AND entity = 'partner_id'").agg(
        F.count("*").alias("n")
    )


@query("incremental_deletions", """
  SELECT CASE WHEN p_partkey % 5 = 1 THEN 'wizards' ELSE 'models' END AS folder, count(*) AS n
  FROM part
  WHERE p_size % 3 <> 0 AND p_partkey % 5 <> 0 AND (p_partkey % (SELECT count(*) FROM supplier)) % 4 <> 0
  GROUP BY 1
""")
def incremental_deletions(c: Corpus):
    """Many2one findings after files came, a fifth moved, a fifth went, and a fourth of the modules went whole."""
    base = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/log-{uuid.uuid4().hex}"
    files = c.files.where("name LIKE '%.py'")
    key = F.regexp_extract("path", r"/m_(\d+)\.py$", 1).try_cast("int")
    module = F.regexp_extract("path", r"/mod_(\d+)/", 1).try_cast("int")

    def log(rows, version: int, deleted: bool):
        return rows.withColumns({"version": F.lit(version), "deleted": F.lit(deleted)})

    moved = files.where(key % 5 == 1)
    batches = [
        log(files, 1, False),
        log(moved.withColumn("path", F.replace("path", F.lit("/models/"), F.lit("/wizards/"))), 2, False)
        .unionByName(log(files.where((key % 5).isin(0, 1)), 2, True)),
        log(files.where(module % 4 == 0), 3, True).unionByName(
            log(moved.where(module % 4 == 0)
                .withColumn("path", F.replace("path", F.lit("/models/"), F.lit("/wizards/"))), 3, True)),
    ]
    schema = batches[0].schema
    for batch in batches:
        batch.write.mode("append").parquet(f"{base}/in")
        streams.incremental_scan(
            c.spark.readStream.schema(schema).parquet(f"{base}/in"),
            lambda: streams.latest_files(c.spark.read.schema(schema).parquet(f"{base}/in")),
            f"{base}/out", f"{base}/state",
        ).awaitTermination()
    streams.compact_findings(c.spark, f"{base}/out", f"{base}/small")
    found = streams.current_findings(c.spark, f"{base}/small").where("rule_id = 'DAT001' AND entity = 'partner_id'")
    folder = F.regexp_extract("file", r"/(models|wizards)/", 1)
    return found.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


@query("scan_corpus", """
  SELECT 'source=' || source AS repo, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) q
  WHERE line <> '' GROUP BY source
""")
def scan_corpus(c: Corpus):
    """Document lines written as text files by source, scanned back as a corpus."""
    root = f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    lines = c.table("documents").select("source", F.explode(F.split("text", "\n")).alias("value"))
    lines.where("value <> ''").write.partitionBy("source").text(root)
    files = sources.scan_corpus(c.spark, root)
    return (
        python_source.explode_lines(files)
        .where("text <> ''")
        .groupBy("repo")
        .agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    )
