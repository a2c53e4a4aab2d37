"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b), component being the smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, under its
    smallest neighbour; the number of rounds grows with the logarithm of the longest
    path. Each round is a written table, so a lost executor costs only its tasks. A node
    with very many links is a skewed join key that adaptive execution splits. Nulls and
    loops are left out; an empty table gives an empty table.
    """
    edges = links.where("a < b").select(F.col("b").alias("u"), F.col("a").alias("v"))
    edges = edges.unionByName(links.where("a > b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    edges = materialize(edges.distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u").where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mark), F.sum(F.pmod(mark, F.lit(1 << 30)))).first())
