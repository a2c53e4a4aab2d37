"""Figures over entities and findings.

Counts are pre-aggregated before any shuffle and keyed by repository, so one
large repository is a few partial sums, not one large group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.fixed_values import (
    CATEGORIES,
    DEFAULT_VERSION,
    LEGACY_VERSION,
    SEVERITIES,
    SEVERITY_WEIGHT,
    VERSION_PREFIX,
)
from addonscope.operators.entities import MODEL_KEY
from addonscope.operators.modules import MODULE_KEY, with_module

_COUNTED = ["modules", "models", "fields", "methods", "views", "actions", "menus"]


def _tally(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Partial counts ``(by..., metric, n)`` of one entity."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).select(
        *by, F.lit(name).alias("metric"), "n"
    )


def _spread(tallies: list[DataFrame], by: list[str], metrics: list[str]) -> DataFrame:
    both = reduce(DataFrame.unionByName, tallies)
    return both.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m)
        for m in metrics
    ])


def entity_counts(entities: dict[str, DataFrame], by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Modules, models, fields, methods, views, actions and menus per repository."""
    keys = list(by)
    tallies = [_tally(entities[name], keys, name) for name in _COUNTED]
    return _spread(tallies, keys, _COUNTED).withColumnsRenamed(
        {name: "total_" + name for name in _COUNTED}
    )


def _count_if(column: str, value: str) -> Column:
    return F.count_if(F.col(column) == value)


def issues_by_severity(issues: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    return issues.groupBy(*by).agg(*[_count_if("severity", s).alias(s) for s in SEVERITIES])


def issues_by_category(issues: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    return issues.groupBy(*by).agg(*[_count_if("category", c).alias(c) for c in CATEGORIES])


def display_severity(issues: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Counts as lists show them: ``error`` is critical, anything unknown is info."""
    shown = F.lower("severity")
    critical = shown.isin("critical", "error")
    return issues.groupBy(*by).agg(
        F.count_if(critical).alias("critical"),
        F.count_if(shown == "warning").alias("warning"),
        F.count_if(~critical & (shown != "warning")).alias("info"),
        F.count("*").alias("total"),
    )


def raw_score() -> Column:
    return F.lit(100) - reduce(
        lambda a, b: a + b, [F.col(s) * w for s, w in SEVERITY_WEIGHT.items()]
    )


def health_band(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "attention").otherwise("critical")


def health(severities: DataFrame) -> DataFrame:
    """Adds the unclamped score, the score (never below 0) and its band."""
    score = F.greatest(F.lit(0), F.col("raw_score"))
    return (
        severities.withColumn("raw_score", raw_score())
        .withColumn("health_score", score)
        .withColumn("health_band", health_band(F.col("health_score")))
    )


def version_detected(models: DataFrame, modules: DataFrame) -> DataFrame:
    """Framework version per repository.

    The first manifest version (by module path); else the legacy version where a
    model uses legacy imports; else the default.
    """
    versions = modules.where("version <> ''").groupBy("repo").agg(
        F.min_by("version", "module_path").alias("version")
    )
    legacy = models.groupBy("repo").agg(F.bool_or(F.col("style") == "old").alias("legacy"))
    repos = modules.select("repo").distinct()
    return (
        repos.join(versions, "repo", "left")
        .join(legacy, "repo", "left")
        .select(
            "repo",
            F.when(F.col("version").isNotNull(), F.concat(F.lit(VERSION_PREFIX), "version"))
            .when(F.coalesce("legacy", F.lit(False)), LEGACY_VERSION)
            .otherwise(DEFAULT_VERSION)
            .alias("version_detected"),
        )
    )


def stats(entities: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """One row per repository: counts, findings, score and version."""
    severity = issues.groupBy("repo").agg(
        *[_count_if("severity", s).alias(s) for s in SEVERITIES],
        *[_count_if("category", c).alias(c) for c in CATEGORIES],
    )
    joined = entity_counts(entities).join(severity, "repo", "left").join(
        version_detected(entities["models"], entities["modules"]), "repo", "left"
    )
    return health(joined.na.fill(0, [*SEVERITIES, *CATEGORIES]))


def module_health(issues: DataFrame, dirs: DataFrame) -> DataFrame:
    """Findings and score per module, by the folder of the file they are in."""
    placed = with_module(issues.select("repo", F.col("file").alias("path"), "severity"), dirs)
    # A finding about a missing file lies in a folder that may not exist.
    named = placed.withColumn(
        "module_path",
        F.coalesce("module_path", F.regexp_extract("path", "^(.*?)/(?:security/)?[^/]*$", 1)),
    )
    return health(issues_by_severity(named, ("repo", "module_path")))


def model_inventory(models: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Field and method counts per model, with what the model inherits."""
    parts = _spread(
        [_tally(fields, MODEL_KEY, "fields"), _tally(methods, MODEL_KEY, "methods")],
        MODEL_KEY,
        ["fields", "methods"],
    )
    return (
        models.join(parts, MODEL_KEY, "left")
        .na.fill(0, ["fields", "methods"])
        .select(
            "repo",
            "module_path",
            "path",
            "model",
            "class_name",
            F.array_join("inherit", ", ").alias("inherits_from"),
            F.col("fields").alias("field_count"),
            F.col("methods").alias("method_count"),
            "description",
        )
    )


def severity_share(severities: DataFrame) -> DataFrame:
    """Each severity as a share of all findings of its repository."""
    total = reduce(lambda a, b: a + b, [F.col(s) for s in SEVERITIES])
    return severities.select(
        "repo",
        *[
            F.when(total > 0, F.col(s) / total).otherwise(F.lit(0.0)).alias(s + "_share")
            for s in SEVERITIES
        ],
    )


def category_share(categories: DataFrame) -> DataFrame:
    """Each category with its count relative to the largest category."""
    largest = F.greatest(F.lit(1), *[F.col(c) for c in CATEGORIES])
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("n"), (F.col(c) / largest).alias("share"))
        for c in CATEGORIES
    ])
    return categories.select("repo", F.inline(rows))


def summary_sheet(stats_df: DataFrame) -> DataFrame:
    """Metric and value rows of each repository, in sheet order."""
    metrics = [
        ("Health Score", F.concat(F.col("health_score").cast("string"), F.lit("/100"))),
        ("Version Detected", F.col("version_detected")),
        ("Total Modules", F.col("total_modules")),
        ("Total Models", F.col("total_models")),
        ("Total Fields", F.col("total_fields")),
        ("Total Methods", F.col("total_methods")),
        ("Total Views", F.col("total_views")),
        ("Critical", F.col("critical")),
        ("Warning", F.col("warning")),
        ("Info", F.col("info")),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(name).alias("metric"),
                 value.cast("string").alias("value"))
        for i, (name, value) in enumerate(metrics)
    ])
    return stats_df.select("repo", F.inline(rows))


def module_overview(modules: DataFrame, models: DataFrame) -> DataFrame:
    """Model count, version and dependencies of each module."""
    counts = models.groupBy(*MODULE_KEY).agg(F.count("*").alias("model_count"))
    return modules.join(counts, MODULE_KEY, "left").select(
        *MODULE_KEY,
        "module_name",
        F.coalesce("model_count", F.lit(0)).alias("model_count"),
        F.coalesce(F.nullif("version", F.lit("")), F.lit("-")).alias("version"),
        F.coalesce(F.array_join("depends", ", "), F.lit("-")).alias("depends"),
    )


def reference_targets(
    views: DataFrame, actions: DataFrame, menus: DataFrame, record_rules: DataFrame,
    dirs: DataFrame,
) -> DataFrame:
    """Groups and views that the XML of each module refers to, one row per target."""
    groups = reduce(
        DataFrame.unionByName,
        [
            rows.select("repo", "path", F.lit("group").alias("kind"),
                        F.explode("groups").alias("target"))
            for rows in (actions, menus, record_rules)
        ],
    )
    parents = views.where("inherit_id <> ''").select(
        "repo", "path", F.lit("view").alias("kind"), F.col("inherit_id").alias("target")
    )
    return (
        with_module(groups.unionByName(parents).distinct(), dirs)
        .select(*MODULE_KEY, "kind", "target")
        .distinct()
    )


#: Registers of a sketch as a power of two; the standard error is about 1.04 / 2^6.
_SKETCH_SIZE = 12


def issue_rollup(issues: DataFrame, dirs: DataFrame) -> DataFrame:
    """Findings by file, module, repository and in all, with how many entities they are about.

    ``level`` is file, module, repository or all; keys above it are empty.  ``entities`` is
    exact; ``entities_estimate`` comes from sketches made for each file and merged upwards,
    within about 5 percent, at a size that does not grow with the findings: stored per file
    they answer any grouping later.
    """
    keys = ["repo", "module_path", "path"]
    placed = with_module(
        issues.select("repo", F.col("file").alias("path"), "severity", "entity"), dirs
    ).withColumn("module_path", F.coalesce("module_path", F.lit("")))
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    per_file = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), *counts, F.hll_sketch_agg("entity", _SKETCH_SIZE).alias("sketch")
    )
    levels = F.create_map(*[
        F.lit(x) for pair in ((0, "file"), (1, "module"), (3, "repository"), (7, "all")) for x in pair
    ])
    level = F.element_at(levels, F.grouping_id().cast("int")).alias("level")

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})

    summed = named(per_file.rollup(*keys).agg(
        level, F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in SEVERITIES],
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("entities_estimate"),
    ))
    exact = named(
        placed.select(*keys, "entity").distinct().rollup(*keys).agg(
            level, F.count_distinct("entity").alias("entities")
        )
    )
    return summed.join(exact, [*keys, "level"])
