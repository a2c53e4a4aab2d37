"""Writers for findings, reports and rewritten files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.operators.rules import localize_issues
from addonscope.operators.stats import summary_sheet

# Column titles of the exported issue list.
ISSUE_HEADERS = {
    "en": ["Issue ID", "Severity", "Category", "Title", "Description", "File", "Line", "Suggestion"],
    "id": ["ID Masalah", "Tingkat Keparahan", "Kategori", "Judul", "Deskripsi", "File", "Baris",
           "Saran"],
}
_ISSUE_COLUMNS = [
    "rule_id", "severity", "category", "title", "description", "file", "line", "suggestion",
]

# Writers a repository is dealt to.
_SLICES = 16


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines below ``path``."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def issue_list(issues: DataFrame, lang: str = "id") -> DataFrame:
    """The eight exported columns under their titles in the language."""
    shown = localize_issues(issues, lang).withColumn(
        "rule_id", F.coalesce(F.nullif("rule_id", F.lit("")), "id")
    )
    return shown.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(title)
        for c, title in zip(_ISSUE_COLUMNS, ISSUE_HEADERS[lang])
    ])


def write_issues_csv(issues: DataFrame, path: str, lang: str = "id") -> None:
    """Issues as CSV: every value quoted, quotes doubled, titled columns."""
    (
        issue_list(issues, lang)
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_report_tables(
    stats: DataFrame, issues: DataFrame, inventory: DataFrame, path: str, lang: str = "id"
) -> None:
    """The three sheets of the report: summary, issues and models."""
    summary_sheet(stats).write.mode("overwrite").parquet(f"{path}/summary")
    localize_issues(issues, lang).select(*_ISSUE_COLUMNS).write.mode("overwrite").parquet(
        f"{path}/issues"
    )
    inventory.write.mode("overwrite").parquet(f"{path}/models")


def write_fixed_files(fixed: DataFrame, path: str) -> None:
    """Rewritten files that have at least one fix, by repository."""
    (
        fixed.where(F.size("fixes") > 0)
        .select("repo", "path", "fixed_content")
        # one writer for a slice of a repository, so that there are few files of each
        .repartition("repo", F.pmod(F.xxhash64("path"), F.lit(_SLICES)))
        .write.mode("overwrite")
        .partitionBy("repo")
        .parquet(path)
    )
