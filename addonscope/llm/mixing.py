"""Sources mixed to target weights by weighted fair queueing, in DataFrame expressions.

Every source is a queue of its documents in a shuffled order, offered again when it runs
out. A document's virtual finish time is the number of words its source has sent up to its
end, over the source's target. The mix is the documents in order of that time, cut where
the total budget is spent: the weights are the targets, so that is time 1 for all sources
at once, and a document in service then counts with the words it has sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from addonscope.llm.common import fresh, row_key
from addonscope.session import materialize

WEIGHTS = (1, 2, 3)
#: Times a source can be sent.
REPEATS = 3
#: Hexadecimal digits of the shuffle key that split a source into parts.
PART_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in order of code points, nulls last, weigh ``WEIGHTS`` in turn and share the
    total. A target stops at ``REPEATS`` times its source's size; the rest is shared anew
    by weight. In the end all sources that do not stop have the same ratio of target to
    weight, so with sources in order of limit over weight the ratio is that of the first
    source whose limit exceeds it. The windows run over one row per source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(turn - 1, F.lit(len(WEIGHTS))) + 1)
    limited = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * REPEATS)
    by = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    every = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    ranked = limited.withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("stop") / F.col("weight"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(every)
    shared = ranked.withColumn("at", F.coalesce(level, F.lit(0.0)))
    target = F.least(F.col("at") * F.col("weight"), F.col("stop").cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, source_size, target, taken, virtual_finish) of every row of ``docs``.

    ``docs`` has doc_id, text and source. ``taken`` counts the words the mix takes of the
    document, repeats included: at most ``REPEATS`` times its size. ``virtual_finish`` is
    that of its first turn; null where the target is 0. Texts that are null or blank have size 0 and are never
    taken. Order within a source: MD5 of the id, then id and content, so reruns agree;
    equal rows are interchangeable. A source is split by the first digits of that key:
    sums of the parts give each part's start, so no task holds a whole source.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        "doc_id", row_key().alias("row"), "source", words(F.col("text")).alias("size"), key.alias("key")
    )
    rows = materialize(rows.withColumn("part", F.left("key", F.lit(PART_DIGITS))), "sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sized = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    by = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(by), F.lit(0)))
    p, s = parts.alias("p"), sized.alias("s")
    parts = p.join(s, F.expr("p.source <=> s.source")).select("p.source", "p.part", "start", "source_size", "target")
    r, p = rows.alias("r"), parts.alias("p")
    placed = r.join(p, F.expr("r.part = p.part and r.source <=> p.source")).select(
        "r.*", "p.start", "p.source_size", "p.target"
    )
    within = W.partitionBy("source", "part").orderBy("key", "doc_id", "row")
    sent = F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) + F.col("start")
    placed = placed.withColumn("sent", sent)
    quota = F.floor(F.col("target") + 0.5).cast("bigint")
    taken = sum(
        F.greatest(F.lit(0), F.least("size", quota - turn * F.col("source_size") - F.col("sent") + F.col("size")))
        for turn in map(F.lit, range(REPEATS))
    )
    finish = F.when(F.col("target") > 0, F.col("sent") / F.col("target"))
    return placed.select(
        "doc_id", "row", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
        finish.alias("virtual_finish"),
    )


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix in global order of virtual finish time, with size, target and taken words.

    Columns of ``docs`` with these names are replaced. Documents the mix does not reach
    are left out.
    """
    chosen = mix(docs).where("taken > 0").select("row", "size", "target", "taken", "virtual_finish")
    # equal rows share a key; their places in the queue are interchangeable
    chosen = chosen.groupBy("row").agg(
        F.max("size").alias("size"), F.max("target").alias("target"), F.max("taken").alias("taken"),
        F.min("virtual_finish").alias("virtual_finish"),
    )
    added = ["size", "target", "taken", "virtual_finish"]
    kept = docs.drop(*added)
    names, own = kept.columns, fresh(kept, "own_row")
    d, c = kept.withColumn(own, row_key()).alias("d"), chosen.alias("c")
    joined = d.join(c, F.col(f"d.{own}") == F.col("c.row")).select(
        *[F.col(f"d.`{n}`") for n in names], *[F.col(f"c.{n}") for n in added]
    )
    return joined.orderBy("virtual_finish", "doc_id")
