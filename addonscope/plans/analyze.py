"""The whole analysis: files -> entity tables -> findings, graphs and figures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextvars import Context, copy_context

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addonscope.functions import text as T
from addonscope.operators import (
    data_files,
    entities,
    graph,
    modules,
    python_source,
    rules,
    stats,
    xml_records,
)
from addonscope.rule_texts import DEFAULT_RULES
from addonscope.session import materialize
from addonscope.sources.corpus import (
    archive_errors,
    classify,
    rejected_files,
    scan_archives,
    scan_corpus,
    unique_files,
)


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each built when it is first asked for and then kept.

    A table is written where the tables were set up, whoever asks for it.
    """

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}
        self._context: Context = copy_context()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._context.copy().run(self._builders[name])
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def extract(files: DataFrame) -> Tables:
    """Entity tables of a corpus.

    Source text is read once for the class items (the only shuffle of text) and
    once per other kind of file.  The entities are written as tables: many
    operators share them, and each then starts from a pruned scan instead of
    the whole extraction.  A table is extracted when something first reads it, so
    findings about methods do not wait for the XML files.  Methods stay a
    projection of the items, which already hold their bodies.
    """

    def table(name: str, rows: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: materialize(rows(), name)

    def placed(rows: DataFrame) -> DataFrame:
        return modules.with_module(rows, tables["dirs"])

    tables = Tables({
        "files": lambda: files,
        "items": table("items", lambda: python_source.class_items(files)),
        "elements": table("elements", lambda: xml_records.xml_elements(files)),
        "dirs": table("dirs", lambda: modules.module_dirs(files)),
        "manifests": table("manifests", lambda: data_files.manifests(files)),
        "modules": table("modules", lambda: modules.modules(files, tables["manifests"], tables["dirs"])),
        "models": table("models", lambda: placed(entities.models(tables["items"]))),
        "fields": table("fields", lambda: entities.fields(tables["items"])),
        "methods": lambda: entities.methods(tables["items"]),
        "sql_constraints": lambda: entities.sql_constraints(tables["items"]),
        "states": lambda: entities.states(tables["fields"]),
        "views": lambda: xml_records.views(tables["elements"]),
        "actions": lambda: xml_records.actions(tables["elements"]),
        "menus": table(
            "menus",
            lambda: placed(xml_records.menus(tables["elements"]))
            .withColumn("module", T.base_name(F.col("module_path")))
            .drop("module_path"),
        ),
        "record_rules": table("record_rules", lambda: placed(xml_records.record_rules(tables["elements"]))),
        "access_rights": table("access_rights", lambda: placed(data_files.access_rights(files))),
        "translations": lambda: data_files.translations(files),
        "parse_errors": lambda: xml_records.xml_errors(tables["elements"]),
    })
    return tables


def analyze(files: DataFrame, rule_ids: Iterable[str] = tuple(DEFAULT_RULES)) -> dict[str, DataFrame]:
    """The whole analysis of ``repo, path, content`` rows.

    Adds to the entity tables: relationships, flows, transitions, issues (written,
    since every figure reads them), stats, and only the non-empty modules.
    """
    tables = dict(extract(materialize(unique_files(classify(files)), "files")))

    def placed(name: str) -> DataFrame:
        return modules.with_module(tables[name], tables["dirs"])

    tables["modules"] = modules.non_empty_modules(
        tables["modules"],
        [
            tables["models"], tables["access_rights"], placed("views"), placed("actions"),
            placed("menus"),
        ],
    )
    flows = graph.flows(tables["models"], tables["fields"])
    issues = materialize(rules.detect(tables, rule_ids), "issues")
    return {
        **tables,
        "relationships": graph.model_relationships(tables["models"], tables["fields"]),
        "flows": flows,
        "transitions": graph.transitions(tables["methods"], flows),
        "issues": issues,
        "stats": stats.stats(tables, issues),
    }


def analyze_tree(
    spark: SparkSession, root: str, max_bytes: int | None = None, rule_ids: Iterable[str] = tuple(DEFAULT_RULES)
) -> dict[str, DataFrame]:
    """The whole analysis of a folder of repositories, zip archives in it included.

    ``parse_errors`` also holds the files that were left out and what could not be read.
    """
    files = scan_corpus(spark, root, max_bytes).unionByName(scan_archives(spark, root, max_bytes))
    tables = analyze(files, rule_ids)
    left_out = rejected_files(spark, root, max_bytes).unionByName(archive_errors(spark, root, max_bytes))
    return {**tables, "parse_errors": tables["parse_errors"].unionByName(left_out)}
