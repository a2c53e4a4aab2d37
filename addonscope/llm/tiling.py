"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of ASCII letters and digits and of all other non-ASCII bytes, in
lower case. Seeds are rolling (Karp-Rabin) hashes of five words. Documents and benchmark
items are joined on shared seeds; in each pair the longest matches that do not overlap are
marked, longest first. A document is contaminated when the tiles cover enough of an item,
in whatever order its passages come.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import chunks, row_key, text_bytes
from addonscope.session import materialize

#: Words of a seed; no tile is shorter.
WORDS = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Bits of the filter that documents' seeds pass before the join; its size does not depend on the data.
FILTER_BITS = 1 << 23

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_IS_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out, value = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = value
        value = value * base & _MASK
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each word."""
    is_word = _IS_WORD[raw]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    first[inner] = is_word[inner]
    doc = np.searchsorted(at, np.flatnonzero(first), side="right") - 1
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    begins = first[is_word]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.r_[starts, len(begins)])
    place = np.arange(len(begins)) - np.repeat(starts, sizes)
    letters = (_LOWER[raw[is_word]] + np.uint64(1)) * _powers(int(sizes.max()), _BASE)[place]
    return doc, _mix(np.add.reduceat(letters, starts) + sizes.astype(np.uint64))


def seeds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position, hash) of each run of five words, and the words per document."""
    doc, h = word_hashes(raw, at)
    n_words = np.bincount(doc, minlength=len(at) - 1)
    if len(h) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i, power in enumerate(_powers(WORDS, 0xD1B54A32D192ED03)):
        total += h[i : i + n] * power
    whole = doc[:n] == doc[WORDS - 1 :]
    place = np.arange(len(h)) - (np.cumsum(n_words) - n_words)[doc]
    return doc[:n][whole], place[:n][whole], _mix(total[whole]).view(np.int64), n_words


def _rows(keep=None, words: bool = False):
    """Batches (key, text) to (key, position, seed); with ``words`` also the words of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch["text"])
            keys = batch["key"]
            for first, last in chunks(at):
                doc, place, seed, n = seeds(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                if keep is not None:
                    some = keep(seed)
                    doc, place, seed = doc[some], place[some], seed[some]
                columns = [keys.take(pa.array(doc + first)), pa.array(place.astype(np.int32)), pa.array(seed)]
                if words:
                    columns.append(pa.array(n[doc].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "place", "seed", "words"][: 3 + words])

    return work


def _filter(items: DataFrame):
    """A test that all seeds of ``items`` pass, and few others; at most FILTER_BITS / 8 rows are collected."""
    slot = F.pmod("seed", F.lit(FILTER_BITS))
    bits = items.groupBy(F.floor(slot / 8).alias("byte")).agg(
        F.bit_or(F.pow(F.lit(2), F.pmod(slot, F.lit(8))).cast("int")).alias("bits")
    )
    found = bits.toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[found["byte"].to_numpy(int)] = found["bits"].to_numpy(int)

    def keep(seed: np.ndarray) -> np.ndarray:
        at = seed & (FILTER_BITS - 1)
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return keep


def tiles(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiling from shared seeds at word ``i`` of one text and ``j`` of the other.

    (start in the first, start in the second, words), longest first; ties go to the
    earlier start in the first, then the second text.
    """
    pairs = np.unique(np.stack([j - i, i]), axis=1)
    shift, i = pairs
    new = np.r_[True, (shift[1:] != shift[:-1]) | (i[1:] != i[:-1] + 1)]
    at = np.flatnonzero(new)
    sizes = np.diff(np.r_[at, len(i)]) + WORDS - 1
    queue = [(-int(n), int(a), int(a + s)) for n, a, s in zip(sizes, i[at], shift[at])]
    heapq.heapify(queue)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while queue:
        n, a, b = heapq.heappop(queue)
        free = [a + k not in used_i and b + k not in used_j for k in range(-n)]
        if all(free):
            out.append((a, b, -n))
            used_i.update(range(a, a - n))
            used_j.update(range(b, b - n))
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= WORDS:
                    heapq.heappush(queue, (start - k, a + start, b + start))
                start = None
    return out


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    found = tiles(pdf["place"].to_numpy(np.int64), pdf["item_place"].to_numpy(np.int64))
    covered = sum(n for _, _, n in found)
    row = pdf.iloc[0]
    return pd.DataFrame(
        {
            "key": [row["key"]], "item": [row["item"]], "n_tiles": [len(found)],
            "coverage": [covered / float(row["words"])],
        }
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, n_tiles, coverage) of documents (key, text) and items (item_id, text) that share enough.

    Pairs whose shared seeds cannot make up the coverage are left out before tiling: a
    tile of n words holds n - 4 seeds, at least a fifth of n. Items of fewer than five
    words have no seed and match nothing. Equal seeds count as equal words.
    """
    kind = dict(docs.dtypes)["key"]
    named = benchmark.select(row_key("item_id").alias("item"), "item_id", "text")
    items = named.select(F.col("item").alias("key"), "text").mapInArrow(
        _rows(words=True), "key bigint, place int, seed bigint, words int"
    )
    items = materialize(
        items.select(F.col("key").alias("item"), F.col("place").alias("item_place"), "seed", "words").distinct(),
        "benchmark_seeds",
    )
    hits = docs.select("key", "text").mapInArrow(_rows(_filter(items)), f"key {kind}, place int, seed bigint")
    shared = hits.join(items, "seed")
    enough = (
        shared.groupBy("key", "item", "words").agg(F.count_distinct("item_place").alias("n"))
        .where(F.col("n") * WORDS >= F.col("words") * COVERAGE).drop("n", "words")
    )
    tiled = shared.join(enough, ["key", "item"], "left_semi").groupBy("key", "item").applyInPandas(
        _tile, f"key {kind}, item bigint, n_tiles int, coverage double"
    )
    return tiled.join(named.select("item", "item_id").distinct(), "item").drop("item")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, n_tiles, coverage) of the most covered item of each contaminated row.

    ``row`` is the key of ``common.row_key``; ties go to the smallest item. Null and empty
    texts, and an empty benchmark, contaminate nothing.
    """
    rows = docs.select(row_key().alias("key"), "text")
    found = overlaps(rows, benchmark).where(F.col("coverage") >= COVERAGE)
    best = F.min_by(F.struct("item_id", "n_tiles", "coverage"), F.struct(-F.col("coverage"), F.col("item_id")))
    return found.groupBy("key").agg(best.alias("x")).select(F.col("key").alias("row"), "x.*")
