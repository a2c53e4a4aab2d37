"""Registered queries and the tables they share within a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from addonscope.operators import fixes, graph, rules, stats
from addonscope.plans.analyze import extract
from addonscope.session import materialize
from addonscope.sources.corpus import classify
from workload.corpus import derived_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the shuffle partitions, since the tables are few files and the text is not."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Corpus:
    """Tables of the corpus derived from one set of star tables.

    Built on first use and written, as an analysis run would leave them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that several queries share, written on first use."""
        if name not in self._kept:
            self._kept[name] = materialize(build(), name)
        return self._kept[name]

    @cached_property
    def files(self) -> DataFrame:
        return materialize(
            derived_files(self.spark, self.sf_dir, spread).transform(classify), "files"
        )

    @cached_property
    def entities(self) -> dict[str, DataFrame]:
        return extract(self.files)

    @cached_property
    def issues(self) -> DataFrame:
        """Findings of the default rules."""
        return materialize(rules.detect(self.entities), "issues")

    @cached_property
    def relationships(self) -> DataFrame:
        return graph.model_relationships(self.entities["models"], self.entities["fields"])

    @cached_property
    def flows(self) -> DataFrame:
        return graph.flows(self.entities["models"], self.entities["fields"])

    @cached_property
    def transitions(self) -> DataFrame:
        return materialize(
            graph.transitions(self.entities["methods"], self.flows), "transitions"
        )

    @cached_property
    def fixed(self) -> DataFrame:
        return fixes.fix_corpus(self.files, self.issues)

    @cached_property
    def stats(self) -> DataFrame:
        return stats.stats(self.entities, self.issues)


_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        _CORPORA[key] = Corpus(spark, sf_dir)
    return _CORPORA[key]


def query(name: str, sql: str | None = None):
    """Registers a function of the corpus, with its SQL where it has one."""

    def register(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
