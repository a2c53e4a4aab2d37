"""Pairs of texts that share four fifths of their five-word shingles.

Min-hashes of a text's shingles make the keys of its bands; texts that share a key are
candidates. What hangs together by candidates is a cluster, and all pairs of a cluster are
compared on their whole sets of shingles, so a link is never an estimate. Only a pair
without any common key is missed: at similarity 0.8 that is (1 - 0.8^5)^32, 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.llm.anchors import shingle_hashes
from addonscope.llm.common import chunks, forest, row_key, starts_of, text_bytes, whole_groups
from addonscope.llm.components import connected_components
from addonscope.session import materialize, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 20240517
#: Texts, and shingles, of a cluster that one task compares with each other; larger clusters
#: are split into cells, one for each pair of parts.
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 20
#: Shingles that are columns of a matrix at a time.
COLUMNS = 4096


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, bands): a 64-bit key of each band of each set; the sets lie end to end."""
    rng = np.random.default_rng(SEED)
    mixed, odd = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(starts), axis=0)
    for i in range(BANDS * ROWS):
        least = np.minimum.reduceat((values ^ mixed[i]) * (odd[i] | np.uint64(1)), starts)
        key = (out[:, i // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i // ROWS] = key ^ key >> np.uint64(29)
    return out.view(np.int64)


def sketch_batches(shingle: int):
    """(row, words, size, keys) of the texts that have words; equal words, equal rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch["text"])
            row = batch["row"].to_numpy()
            for first, last in chunks(at):
                texts = [raw[at[i] : at[i + 1]].tobytes() for i in range(first, last)]
                sets = [shingle_set(t, shingle) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                sizes = np.array([len(sets[i]) for i in full])
                keys = band_keys(np.concatenate([sets[i] for i in full]), np.cumsum(sizes) - sizes)
                words = [xxhash.xxh64_intdigest(b" ".join(texts[i].lower().split()), SEED) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[first:last][full]), pa.array(np.array(words, np.uint64).view(np.int64)), pa.array(sizes),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())
                        ),
                    ],
                    names=["row", "words", "size", "keys"],
                )

    return work


def similar(sets: list[np.ndarray], own: np.ndarray, other: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i of ``own``, j of ``other``) whose sets are as similar as ``similarity``, or more."""
    sizes = np.array([len(s) for s in sets])
    _, name, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    # what only one text has is in no intersection
    shared = often[name] > 1
    doc, name = doc[shared], name[shared]
    order = np.argsort(name, kind="stable")
    doc, name = doc[order], name[order]
    column = np.cumsum(np.r_[False, name[1:] != name[:-1]]) if len(name) else name
    both = np.zeros((len(own), len(other)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        matrix = np.zeros((len(sets), column[b - 1] - low + 1), np.float32)
        matrix[doc[a:b], column[a:b] - low] = 1
        both += matrix[own] @ matrix[other].T
    union = sizes[own][:, None] + sizes[other][None] - both
    return np.nonzero(both >= similarity * union - 1e-9)


def compare(shingle: int, similarity: float):
    """Links (a, b) of whole cells, as many as connect what is similar there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "low", "high"], 1 << 10):
            low, high, part, row = (table[c].to_numpy() for c in ("low", "high", "part", "row"))
            raw, at = text_bytes(table["text"].combine_chunks())
            starts = starts_of(table["component"].to_numpy(), low, high)
            for a, b in zip(starts, np.r_[starts[1:], len(row)]):
                sets = [shingle_set(raw[at[i] : at[i + 1]].tobytes(), shingle) for i in range(a, b)]
                # two parts meet in a cell: only pairs across them are new
                own, other = (np.flatnonzero(part[a:b] == p) for p in (low[a], high[a]))
                i, j = similar(sets, own, other, similarity)
                child, root = forest(row[a + own[i]], row[a + other[j]])
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(child)], names=["a", "b"])

    return work


def _cells(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, component, part, low, high): where each text meets others."""
    sized = clusters.withColumnRenamed("node", "row").join(sizes, "row")
    parts = F.ceil(F.greatest(F.count("*") / CELL_ROWS, F.sum("size") / CELL_SHINGLES)).cast("int")
    met = sized.join(sized.groupBy("component").agg(parts.alias("parts")), "component")
    met = met.withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(
        "row", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )


def similar_rows(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): row keys of ``docs`` (doc_id, text), enough links to connect all similar texts.

    Texts with equal words are one, under the smallest row key; they get no links among
    each other. Texts that are null or have no word get none. Words are compared without
    the case of ASCII letters.
    """
    rows = docs.select(row_key().alias("row"), "text")
    sketches = rows.mapInArrow(sketch_batches(shingle), "row bigint, words bigint, size bigint, keys array<bigint>")
    with small_batches(docs.sparkSession):
        sketches = materialize(sketches, "sketches")
    first = sketches.groupBy("words").agg(F.min("row").alias("row")).select("row")
    classes = materialize(sketches.join(first, "row", "left_semi").dropDuplicates(["row"]), "sketch_classes")
    each = classes.select("row", F.explode("keys").alias("key"))
    heads = each.groupBy("key").agg(F.min("row").alias("a"), F.count("*").alias("count")).where("count > 1")
    met = each.join(heads.select("key", "a"), "key").where("a <> row").select("a", F.col("row").alias("b"))
    clusters = materialize(connected_components(met.distinct()), "clusters")
    cells = materialize(_cells(clusters, classes.select("row", "size")), "cells")
    texts = rows.join(cells.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    placed = (
        cells.join(texts, "row").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
        .select("component", "low", "high", "part", "row", "text")
    )
    with small_batches(docs.sparkSession):
        return materialize(placed.mapInArrow(compare(shingle, similarity), "a bigint, b bigint"), "similar")


def links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b): fingerprints of ``marked`` (row, fp) whose texts are similar."""
    found = similar_rows(docs)
    fps = marked.select("row", "fp").distinct()
    a, b = (fps.select(F.col("row").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    return found.join(a, "a").join(b, "b").where("fp_a <> fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
