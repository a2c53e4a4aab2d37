"""The review store: users, audit log and comments as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from addonscope.fixed_values import ROLES
from addonscope.session import materialize

USERS = "id BIGINT, external_id STRING, name STRING, email STRING, avatar STRING, role STRING"
AUDIT = "timestamp TIMESTAMP, user_id BIGINT, user_name STRING, action STRING, details STRING"
COMMENTS = (
    "issue_id STRING, user_id BIGINT, user_name STRING, user_avatar STRING, "
    "timestamp TIMESTAMP, comment_text STRING"
)


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of the review store."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def audit_rows(
    rows: DataFrame, user_id: Column, user_name: Column, action: Column, details: Column,
    at: Column | None = None,
) -> DataFrame:
    """Audit entries out of any rows; entries without action or details are dropped."""
    made = rows.select(
        (at if at is not None else F.current_timestamp()).alias("timestamp"),
        user_id.cast("bigint").alias("user_id"),
        user_name.alias("user_name"),
        action.alias("action"),
        details.alias("details"),
    )
    return made.where(
        (F.coalesce("action", F.lit("")) != "") & (F.coalesce("details", F.lit("")) != "")
    )


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def valid_comments(comments: DataFrame) -> DataFrame:
    """Comments whose text is more than blanks."""
    return comments.where(
        F.length(F.regexp_replace(F.coalesce("comment_text", F.lit("")), r"^\s+|\s+$", "")) > 0
    )


def comment_audit(comments: DataFrame) -> DataFrame:
    """The audit entry of each accepted comment."""
    return audit_rows(
        valid_comments(comments),
        F.col("user_id"),
        F.col("user_name"),
        F.lit("Add Issue Comment"),
        F.concat(F.lit("Added review comment on issue "), "issue_id"),
        F.col("timestamp"),
    )


def upsert_users(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users after a batch of logins, by external id.

    Known users take the new name, and the new email and avatar where given.
    New users become viewers; the very first user of an empty store is admin.
    New ids follow the largest one in use.  A login twice in a batch counts once.

    Ids are handed out from row counts per partition, so new users are never
    ranked in one task.
    """
    logins = incoming.groupBy("external_id").agg(
        F.max_by(F.struct("name", "email", "avatar"), "seq").alias("login"),
        F.min("seq").alias("seq"),
    )
    last_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    n_users = existing.agg(F.count("*")).scalar()
    known = existing.alias("u").join(logins, "external_id", "left").select(
        "u.id",
        "external_id",
        F.coalesce("login.name", "u.name").alias("name"),
        F.coalesce(F.nullif("login.email", F.lit("")), "u.email").alias("email"),
        F.coalesce(F.nullif("login.avatar", F.lit("")), "u.avatar").alias("avatar"),
        "u.role",
    )
    fresh = logins.join(existing.select("external_id"), "external_id", "left_anti")
    numbered = dense_numbers(fresh, ["seq", "external_id"])
    added = numbered.select(
        (last_id + F.col("number")).cast("bigint").alias("id"),
        "external_id",
        F.col("login.name").alias("name"),
        F.nullif("login.email", F.lit("")).alias("email"),
        F.nullif("login.avatar", F.lit("")).alias("avatar"),
        F.when((n_users == 0) & (F.col("number") == 1), "Admin")
        .otherwise("Viewer")
        .alias("role"),
    )
    return known.unionByName(added)


def dense_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``number`` 1, 2, ... in the given order without one global window.

    Rows are range-partitioned by the order columns; the rank inside a range is
    added to the number of rows in the ranges before it.
    """
    # Written, so that the partition number is the same in both uses.
    ranged = materialize(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        ranged.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(before), "part")
        .withColumn("number", F.col("rank") + F.col("offset"))
        .drop("part", "rank", "offset")
    )


def change_roles(
    users: DataFrame, changes: DataFrame, actor_id: int = 0, actor_name: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users with new roles, the audit entries, and the changes that were refused.

    ``changes``: ``id, role``, one per user.  Unknown roles and users are refused.
    """
    valid = changes.where(F.col("role").isin(ROLES)).withColumnRenamed("role", "new_role")
    after = users.join(valid, "id", "left").select(
        *[c for c in users.columns if c != "role"],
        F.coalesce("new_role", "role").alias("role"),
    )
    audit = audit_rows(
        users.join(valid, "id"),
        F.lit(actor_id),
        F.lit(actor_name),
        F.lit("Modify User Role"),
        F.concat(
            F.lit("Changed user ID "), F.col("id").cast("string"), F.lit(" ("), "name",
            F.lit(") role from "), "role", F.lit(" to "), "new_role",
        ),
    )
    known = users.select("id")
    refused = changes.where(~F.col("role").isin(ROLES)).select(
        "id", "role", F.lit("Invalid role").alias("reason")
    ).unionByName(
        changes.where(F.col("role").isin(ROLES))
        .join(known, "id", "left_anti")
        .select("id", "role", F.lit("User not found").alias("reason"))
    )
    return after, audit, refused


def newest_audit(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries from the newest on; with a limit, every task keeps only its own newest before they meet."""
    ordered = audit.orderBy(F.col("timestamp").desc(), *[
        F.col(c) for c in audit.columns if c != "timestamp"
    ])
    return ordered if limit is None else ordered.limit(limit)


def issue_comments(comments: DataFrame, issue_id: str) -> DataFrame:
    """Comments of one issue, oldest first."""
    return comments.where(F.col("issue_id") == issue_id).orderBy("timestamp")


def comments_of(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """All issues with their comments; sort by ``issue_id, timestamp`` to read them.

    Issue ids hold no repository: where both tables carry a ``repo``, it has to agree.
    """
    both = "repo" in comments.columns and "repo" in issues.columns
    key = ["repo", "issue_id"] if both else ["issue_id"]
    named = issues.withColumnRenamed("id", "issue_id")
    return named.select(*key, "rule_id").distinct().join(comments, key)


def users_by_name(users: DataFrame) -> DataFrame:
    return users.select("id", "name", "email", "avatar", "role").orderBy("name", "id")


def total_users(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total_users"))
