"""Streams: push events into the audit log, new files into the findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from addonscope.fixed_values import MANIFEST_FILES, WEBHOOK_DEFAULTS
from addonscope.functions import text as T
from addonscope.operators import rules
from addonscope.operators.modules import MODULE_KEY, module_dirs, with_module
from addonscope.operators.review import audit_rows
from addonscope.plans.analyze import extract
from addonscope.session import materialize, scratch

PUSH_EVENT = (
    "repository STRUCT<full_name: STRING>, ref STRING, head_commit STRUCT<message: STRING>"
)


def push_details() -> Column:
    """What the audit log says about a push event; every part is optional."""
    repo = F.coalesce("repository.full_name", F.lit(WEBHOOK_DEFAULTS["repo"]))
    ref = F.nullif("ref", F.lit(""))
    branch = F.coalesce(
        F.replace(ref, F.lit("refs/heads/"), F.lit("")), F.lit(WEBHOOK_DEFAULTS["branch"])
    )
    message = F.coalesce("head_commit.message", F.lit(WEBHOOK_DEFAULTS["message"]))
    return F.concat(
        F.lit("Repository: "), repo, F.lit(", Branch: "), branch, F.lit(", Head Commit: "), message
    )


def push_events_to_audit(events: DataFrame) -> DataFrame:
    """Audit entries of push events, for batch and stream alike."""
    return audit_rows(
        events, F.lit(0), F.lit("Git Webhook"), F.lit("Git Push Triggered"), push_details()
    )


def stream_push_events(
    spark: SparkSession, source: str, audit_path: str, checkpoint: str
) -> StreamingQuery:
    """Appends the push events that arrived as JSON files to the audit log."""
    events = spark.readStream.schema(PUSH_EVENT).json(source)
    return (
        push_events_to_audit(events)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(audit_path)
    )


def latest_files(changes: DataFrame, order: str = "version") -> DataFrame:
    """The corpus that a log of changes leads to: files whose last entry is not ``deleted``.

    ``order`` grows with each change of a file.  The last entries are found without the text.
    """
    newest = (
        changes.groupBy("repo", "path")
        .agg(F.max_by("deleted", order).alias("gone"), F.max(order).alias(order))
        .where("NOT coalesce(gone, false)")
        .drop("gone")
    )
    return changes.join(newest, ["repo", "path", order], "left_semi").drop(order, "deleted")


def new_roots(changed: DataFrame) -> DataFrame:
    """Repositories in which a manifest arrived or went."""
    return changed.where(T.base_name(F.col("path")).isin(MANIFEST_FILES)).select("repo").distinct()


def dirs_of(corpus: DataFrame, others: DataFrame) -> DataFrame:
    """Modules of all folders of ``corpus`` and of the paths of ``others``, which need not exist.

    Only files of the corpus can make a folder a module.
    """
    paths = others.select("repo", "path", F.lit(None).cast("string").alias("name")).distinct()
    return module_dirs(corpus.select("repo", "path", "name").unionByName(paths))


def touched_modules(dirs: DataFrame, changed: DataFrame) -> DataFrame:
    """``(repo, module_path)`` of the modules that the changed files belong to, or belonged to.

    A manifest that comes or goes may move files between any modules of its
    repository, so it touches them all.
    """
    every = dirs.select("repo", "module_path").join(new_roots(changed), "repo", "left_semi")
    return _modules_of(changed, dirs).unionByName(every).distinct()


def _modules_of(changed: DataFrame, dirs: DataFrame) -> DataFrame:
    return with_module(changed.select("repo", "path").distinct(), dirs).select("repo", "module_path")


def moved_modules(before: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(repo, module_path)`` of the modules that folders left or went to, and of those inside them.

    ``before`` are the folders with their modules as they were.  A finding of a module
    may name a file in a module inside it.
    """
    now = dirs.select("repo", "dir", F.col("module_path").alias("now"))
    moved = before.join(now, ["repo", "dir"], "left").where("now IS NULL OR now <> module_path")
    ends = moved.select("repo", F.explode(F.array_compact(F.array("module_path", "now"))).alias("module_path")).distinct()
    inside = (
        dirs.select("repo", "module_path").distinct()
        .select("repo", F.col("module_path").alias("inner"), F.explode(T.ancestor_dirs(F.col("module_path"))).alias("module_path"))
        .join(ends, MODULE_KEY, "left_semi")
        .select("repo", F.col("inner").alias("module_path"))
    )
    return ends.unionByName(inside).distinct()


def files_of(corpus: DataFrame, dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """All files of the given modules.

    Rules across files need the whole module, not only what is new.  Folders are
    chosen first, so the text takes part in one join; with a corpus table
    partitioned by ``repo`` that join prunes what is read to their repositories.
    """
    own = dirs.join(modules, MODULE_KEY, "left_semi").select("repo", "dir")
    return (
        corpus.withColumn("dir", T.dir_name(F.col("path"))).join(own, ["repo", "dir"], "left_semi").drop("dir")
    )


def incremental_scan(
    arrivals: DataFrame,
    read_corpus: Callable[[], DataFrame],
    findings_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Analyzes modules again when files of theirs arrive, change or go.

    ``arrivals`` has ``repo`` and ``path``, and may have ``deleted``: a row with it
    true is the tombstone of that file; a file that moves is a tombstone and an
    arrival.  ``read_corpus`` returns the corpus as it is after the changes.  Each
    batch writes its findings as a new version of the touched repositories and
    modules under its batch number, so a batch that runs twice overwrites itself.
    A module or repository without any file left gets an empty version.
    Each batch also leaves the module of every folder: the next one compares them and
    analyzes, of a repository whose manifests came or went, only the modules that folders
    left or went to.  Of a store without them every module is analyzed once.
    The files of the touched modules are read once and kept for the batch;
    the tables between are removed after it.
    """

    def analyze_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            changed = materialize(batch.select("repo", "path").distinct(), "changed")
            corpus = read_corpus()
            paths = materialize(corpus.select("repo", "path", "name"), "paths")
            dirs = materialize(dirs_of(paths, changed), "folders")
            versions, whole = _touched(spark, findings_path, batch_id, dirs, changed)
            touched = materialize(versions, "touched")
            entities = extract(materialize(files_of(corpus, dirs, touched), "files"))
            found = materialize(rules.detect(entities).withColumn("path", F.col("file")), "found")
            # a finding may name a file that is missing, in a folder that is not there
            placed = with_module(found, dirs_of(paths, found.select("repo", "path"))).drop("path")
            placed.write.mode("overwrite").parquet(f"{findings_path}/issues/batch={batch_id}")
            touched.withColumn("whole", F.lit(False)).unionByName(
                whole.select("repo", F.lit("").alias("module_path"), F.lit(True).alias("whole"))
            ).write.mode("overwrite").parquet(f"{findings_path}/modules/batch={batch_id}")
            own = paths.select("repo", T.dir_name(F.col("path")).alias("dir"))
            dirs.join(own, ["repo", "dir"], "left_semi").write.mode("overwrite").parquet(
                f"{findings_path}/folders/batch={batch_id}"
            )

    return (
        arrivals.writeStream.foreachBatch(analyze_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _touched(
    spark: SparkSession, findings_path: str, batch_id: int, dirs: DataFrame, changed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Modules that a batch analyzes, and repositories of which it replaces all there was."""
    seen = _before(spark, f"{findings_path}/modules", batch_id)
    folders = _before(spark, f"{findings_path}/folders", batch_id)
    if seen is None:
        return touched_modules(dirs, changed), new_roots(changed)
    # folders that an older batch left say nothing about the modules of the last one
    if folders is None or _last_batch(folders) < _last_batch(seen):
        every = dirs.select("repo", "module_path").unionByName(_modules_of(changed, dirs)).distinct()
        return every, seen.select("repo").unionByName(dirs.select("repo")).distinct()
    unseen = (
        dirs.select("repo", "module_path")
        .join(new_roots(changed), "repo", "left_semi")
        .join(seen.where("NOT whole"), MODULE_KEY, "left_anti")
    )
    moved = moved_modules(folders.where(F.col("batch") == _last_batch(folders)).drop("batch"), dirs)
    return _modules_of(changed, dirs).unionByName(unseen).unionByName(moved).distinct(), new_roots(changed).limit(0)


def _last_batch(rows: DataFrame) -> int | None:
    return rows.agg(F.max("batch")).first()[0]


def _before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """What the batches before one wrote, or all of them; None where that is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return None
    rows = spark.read.parquet(path)
    if batch_id is not None:
        rows = rows.where(F.col("batch") < batch_id)
    return None if rows.isEmpty() else rows


def _versions(spark: SparkSession, findings_path: str) -> DataFrame:
    """``(repo, module_path, batch)``: the last batch of each module that is not replaced as a whole."""
    seen = spark.read.parquet(f"{findings_path}/modules")
    since = seen.where("whole").groupBy("repo").agg(F.max("batch").alias("since"))
    return (
        seen.groupBy("repo", "module_path")
        .agg(F.max("batch").alias("batch"))
        .join(since, "repo", "left")
        .where("since IS NULL OR batch >= since")
        .drop("since")
    )


def current_findings(spark: SparkSession, findings_path: str) -> DataFrame:
    """Findings of the last batch that analyzed each module.

    A batch that analyzed a whole repository replaces what came before it, also
    for modules that are no more.
    """
    issues = spark.read.parquet(f"{findings_path}/issues")
    versions = _versions(spark, findings_path)
    return issues.join(versions, ["repo", "module_path", "batch"], "left_semi").drop("batch")


def compact_findings(spark: SparkSession, findings_path: str, target_path: str) -> None:
    """Writes what holds as a new store, as one version under the number of the last batch.

    Replaced versions stay behind in the old store.  Scans with the same
    checkpoint go on with the new one.
    """
    seen = spark.read.parquet(f"{findings_path}/modules")
    last = _last_batch(seen) or 0
    current_findings(spark, findings_path).write.parquet(f"{target_path}/issues/batch={last}")
    versions = _versions(spark, findings_path).drop("batch").withColumn("whole", F.lit(False))
    versions.write.parquet(f"{target_path}/modules/batch={last}")
    folders = _before(spark, f"{findings_path}/folders")
    if folders is not None and _last_batch(folders) >= last:
        folders.where(F.col("batch") == _last_batch(folders)).drop("batch").write.parquet(f"{target_path}/folders/batch={last}")
