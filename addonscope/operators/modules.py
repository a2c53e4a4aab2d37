"""Module assignment: which module folder a file belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.fixed_values import MANIFEST_FILES
from addonscope.functions import text as T

MODULE_KEY = ["repo", "module_path"]
NO_MODULE = "unknown_module"


def module_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a manifest: ``(repo, module_path)``."""
    return (
        files.where(F.col("name").isin(MANIFEST_FILES))
        .select("repo", T.dir_name(F.col("path")).alias("module_path"))
        .distinct()
    )


def module_dirs(files: DataFrame) -> DataFrame:
    """Every folder of the corpus with its module: ``(repo, dir, module_path)``.

    The closest folder above (or equal) that holds a manifest wins.  A folder
    under none goes to the longest module path of its repository (ties: the
    smallest), or to the empty path where the repository has no manifest.

    Folders are made distinct first and matched by equality with their list of
    ancestors, so the work follows folders times depth, not files times modules.
    """
    dirs = files.select("repo", T.dir_name(F.col("path")).alias("dir")).distinct()
    roots = module_roots(files)
    nearest = (
        dirs.select("repo", "dir", F.explode(T.ancestor_dirs(F.col("dir"))).alias("module_path"))
        .join(roots, MODULE_KEY)
        .groupBy("repo", "dir")
        .agg(F.max_by("module_path", F.length("module_path")).alias("nearest"))
    )
    longest = roots.groupBy("repo").agg(
        F.min(F.struct((-F.length("module_path")).alias("n"), "module_path")).alias("longest")
    )
    return (
        dirs.join(nearest, ["repo", "dir"], "left")
        .join(longest, "repo", "left")
        .select(
            "repo",
            "dir",
            F.coalesce("nearest", "longest.module_path", F.lit("")).alias("module_path"),
        )
    )


def with_module(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """Adds ``module_path`` to rows with a ``path``, by its folder."""
    return rows.withColumn("dir", T.dir_name(F.col("path"))).join(
        dirs, ["repo", "dir"], "left"
    ).drop("dir")


def assign_modules(files: DataFrame) -> DataFrame:
    """Files without their text, each with its module."""
    return with_module(files.drop("content"), module_dirs(files))


def modules(files: DataFrame, manifests: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row per module, with its manifest where it has one."""
    paths = dirs.select(*MODULE_KEY).distinct()
    heads = files.where(F.col("name").isin(MANIFEST_FILES)).select(
        "repo", "path", F.col("content").alias("manifest_head")
    )
    # A folder with both manifest files keeps the first by path.
    described = manifests.join(heads, ["repo", "path"]).withColumnsRenamed(
        {"name": "title", "path": "manifest_path"}
    )
    columns = [c for c in described.columns if c not in MODULE_KEY]
    described = (
        described.groupBy(*MODULE_KEY)
        .agg(F.min_by(F.struct(*columns), "manifest_path").alias("m"))
        .select(*MODULE_KEY, "m.*")
    )
    name = F.coalesce(F.nullif(T.base_name(F.col("module_path")), F.lit("")), F.lit(NO_MODULE))
    return paths.join(described, MODULE_KEY, "left").select(
        *MODULE_KEY,
        name.alias("module_name"),
        F.col("manifest_path").isNotNull().alias("has_manifest"),
        *columns,
    )


def non_empty_modules(modules_df: DataFrame, entities: list[DataFrame]) -> DataFrame:
    """Drops modules without any entity or manifest name.

    A repository in which every module is empty keeps them all.  ``entities``
    are DataFrames with ``repo`` and ``module_path``.
    """
    filled = reduce(
        DataFrame.unionByName, [e.select(*MODULE_KEY) for e in entities]
    ).distinct().withColumn("filled", F.lit(True))
    marked = modules_df.join(filled, MODULE_KEY, "left").withColumn(
        "filled",
        F.coalesce("filled", F.lit(False)) | (F.coalesce("title", F.lit("")) != ""),
    )
    any_filled = marked.groupBy("repo").agg(F.bool_or("filled").alias("any_filled"))
    return (
        marked.join(any_filled, "repo")
        .where("filled OR NOT any_filled")
        .drop("filled", "any_filled")
    )
