"""Filters over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addonscope.fixed_values import SEVERITIES

ALL = "all"


def mentions(text: str, *columns: str) -> Column:
    """The text occurs in one of the columns, in any case."""
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(text.lower()))
    return found


def filter_issues(
    issues: DataFrame,
    severity: str = ALL,
    category: str = ALL,
    file: str = ALL,
    search: str = "",
) -> DataFrame:
    """Issues that pass every given filter; critical also admits ``error``."""
    if severity == "critical":
        issues = issues.where(F.col("severity").isin("critical", "error"))
    elif severity != ALL:
        issues = issues.where(F.col("severity") == severity)
    if category != ALL:
        issues = issues.where(F.col("category") == category)
    if file != ALL:
        issues = issues.where(F.col("file") == file)
    if search:
        issues = issues.where(mentions(search, "title", "description", "rule_id"))
    return issues


def distinct_files(issues: DataFrame) -> DataFrame:
    return issues.where(F.coalesce("file", F.lit("")) != "").select("repo", "file").distinct()


def distinct_categories(issues: DataFrame) -> DataFrame:
    return issues.select("category").distinct()


def flows_for_model(flows: DataFrame, model: str) -> DataFrame:
    return flows.where(F.col("model") == model)


def severity_rank() -> Column:
    """Position of a severity in report order; unknown ones come last."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return F.when(order > 0, order).otherwise(len(SEVERITIES) + 1)


def report_order(issues: DataFrame) -> DataFrame:
    """Issues from critical to info."""
    return issues.orderBy(severity_rank(), "repo", "file", "line", "rule_id", "id")


def bottom_up(issues: DataFrame) -> DataFrame:
    """Issues of each file from its last line to its first, files kept together."""
    return issues.repartition("repo", "file").sortWithinPartitions(
        "repo", "file", F.col("line").desc(), "rule_id", "id"
    )


def report_relations(relationships: DataFrame, first_n: int) -> DataFrame:
    """The first relations of each repository and how many there are besides.

    The number is part of the report.  The rank limit runs before the shuffle, and
    the rest is counted, not collected.
    """
    first = Window.partitionBy("repo").orderBy("path", "from_model", "field", "to_model")
    shown = (
        relationships.withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= first_n)
        .select("repo", "pos", "from_model", "type", "to_model", "field")
    )
    totals = relationships.groupBy("repo").agg(F.count("*").alias("n"))
    return shown.join(totals, "repo").select(
        "repo", "pos", "from_model", "type", "to_model", "field",
        F.greatest(F.lit(0), F.col("n") - first_n).alias("others"),
    )
