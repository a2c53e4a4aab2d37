"""Which labels occur inside which texts, by grams of the labels.

Every label is found by one of its grams (three characters, or the whole label where that
is shorter): the one that fewest labels of its scope have.  Texts are cut into pieces that
overlap by the longest label, so the work follows their length, however long a word is; a
piece meets the labels whose gram it has, and what meets is verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: Characters by which a piece moves on, at least.
LEAST_STEP = 64


def _grams(text: str, size) -> F.Column:
    """Distinct grams of ``size`` characters."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substr(text, at, size)
        )
    )


def label_grams(labels: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, gram): the gram that stands for each label, rarest among the labels of its scope."""
    size = F.least(F.length("key"), F.lit(GRAM))
    each = labels.select(*scope, "key", F.explode(_grams("key", size)).alias("gram"))
    rare = each.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    return (
        each.join(rare, [*scope, "gram"])
        .groupBy(*scope, "key")
        .agg(F.min(F.struct("n", "gram")).alias("least"))
        .select(*scope, "key", F.col("least.gram").alias("gram"))
    )


def worst_rank(labels: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, key, rank): the least rank of the texts of its scope in which a label occurs.

    ``labels`` (scope, key) are distinct and not empty; ``texts`` (scope, text, rank).  Labels
    found nowhere have no row.  A scope may hold most of all rows: nothing is grouped by the
    scope alone but the lengths of its labels.
    """
    lengths = labels.groupBy(*scope).agg(
        F.max(F.length("key")).alias("longest"),
        F.array_sort(F.collect_set(F.least(F.length("key"), F.lit(GRAM)))).alias("sizes"),
    )
    step = F.greatest(F.col("longest") * 3, F.lit(LEAST_STEP))
    # a label that begins in the first ``step`` characters of a piece ends in it
    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), step),
        lambda at: F.substr("text", at, step + F.col("longest") - 1),
    )
    cut = (
        texts.join(lengths, scope)
        .select(*scope, "rank", "sizes", F.explode(pieces).alias("piece"))
        .groupBy(*scope, "piece")
        .agg(F.min("rank").alias("rank"), F.any_value("sizes").alias("sizes"))
    )
    grams = F.flatten(
        F.transform(
            F.filter("sizes", lambda n: n <= F.length("piece")), lambda n: _grams("piece", n)
        )
    )
    posted = cut.select(*scope, "piece", "rank", F.explode(grams).alias("gram"))
    return (
        posted.join(label_grams(labels, scope), [*scope, "gram"])
        .where(F.contains("piece", F.col("key")))
        .groupBy(*scope, "key")
        .agg(F.min("rank").alias("rank"))
    )
