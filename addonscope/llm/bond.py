"""Hard negatives by a vertical scan of blocks of vectors (branch and bound on decomposed data).

A block holds its vectors by dimension, with each dimension's least and largest value. For
an anchor the dimensions are read in the order of the anchor's components by size. What the
unread ones can still add lies between two sums, so every row's score lies in a range that
narrows; rows whose range misses what is looked for leave the bitmap of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from addonscope.llm.common import fresh
from addonscope.llm.orchard import usable, whole_numbers
from addonscope.session import materialize

POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this many hundredths of the positive.
LEAST_SHARE = 80
#: Integers stay within this, so that scores of 4,096 components are exact in double precision.
LARGEST = 1 << 20
#: Rows and anchors that meet in one task; their vectors are the memory of a task.
BLOCK_ROWS, BLOCK_ANCHORS = 1 << 15, 1 << 11
#: Dimensions read between two looks at the bitmap.
STEP = 8

_NUMBERS = ["row", "vec_id", "label"]


class Block:
    """Vectors of one dimension by dimension, with the range of each."""

    def __init__(self, vectors: np.ndarray):
        self.columns = np.ascontiguousarray(vectors.T.astype(np.float64))
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def scan(self, anchor: np.ndarray, mask: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that ``narrow`` leaves.

        ``narrow(least, most)`` tells which candidates stay, given the range of each score.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort(np.stack([anchor * self.low, anchor * self.high]), axis=0)[:, order]
        # what the dimensions from the i-th on add, at least and at most
        left = np.zeros((2, len(order) + 1))
        left[:, :-1] = ends[:, ::-1].cumsum(1)[:, ::-1]
        rows = np.flatnonzero(mask)
        score = np.zeros(len(rows))
        for first in range(0, len(order), STEP):
            if not len(rows):
                break
            dims = order[first : first + STEP]
            read = self.columns[dims] if len(rows) == len(mask) else self.columns[np.ix_(dims, rows)]
            score += anchor[dims] @ read
            done = min(first + STEP, len(order))
            stay = narrow(score + left[0, done], score + left[1, done])
            if not stay.all():
                rows, score = rows[stay], score[stay]
        return rows, score


def best(block: Block, anchor: np.ndarray, mask: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of the mask that score highest, ties by smaller id."""

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= k:
            return np.ones(len(least), bool)
        return most >= np.partition(least, -k)[-k]

    rows, score = block.scan(anchor, mask, narrow)
    first = np.lexsort((ids[rows], -score))[:k]
    return rows[first], score[first]


def within(
    block: Block, anchor: np.ndarray, mask: np.ndarray, ids: np.ndarray, windows: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) the ``k`` rows that score highest in it, ties by smaller id."""
    low, high = windows[:, 0].copy(), windows[:, 1]

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(least), bool)
        for w in range(len(low)):
            sure = least[(least >= low[w]) & (most <= high[w])]
            if len(sure) >= k:
                # so many are in the window for sure, so it starts at the last of them
                low[w] = max(low[w], np.partition(sure, -k)[-k])
            stay |= (most >= low[w]) & (least <= high[w])
        return stay

    rows, score = block.scan(anchor, mask, narrow)
    found = []
    for a, b in windows:
        inside = np.flatnonzero((score >= a) & (score <= b))
        first = inside[np.lexsort((ids[rows[inside]], -score[inside]))[:k]]
        found.append((rows[first], score[first]))
    return found


def _by_dim(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a table's vectors, by dimension."""
    column = table["vector"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(np.float64).reshape(len(rows), dim)


def _pairs(rows: pa.Table, anchors: pa.Table):
    """Blocks of rows with the anchors of their dimension: (block, ids, labels, row keys, anchors, vectors)."""
    of_dim = {m.shape[1]: (at, m) for at, m in _by_dim(anchors)}
    key, ids, labels = (rows[c].to_numpy() for c in _NUMBERS)
    for at, matrix in _by_dim(rows):
        if matrix.shape[1] in of_dim:
            yield Block(matrix), ids[at], labels[at], key[at], *of_dim[matrix.shape[1]]


def _batch(columns: dict[str, list[np.ndarray]], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table(
        {c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in columns.items()}
    )


_POSITIVE = {"anchor": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64()}
_NEGATIVE = {"anchor": pa.int64(), "place": pa.int32(), "negative_id": pa.int64(), "negative_score": pa.int64()}


def _positives(k: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {c: [] for c in _POSITIVE}
        anchor_key, anchor_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        for block, ids, labels, key, at, vectors in _pairs(rows, anchors):
            for i, vector in zip(at, vectors):
                mask = (labels == anchor_label[i]) & (key != anchor_key[i])
                chosen, score = best(block, vector, mask, ids, k)
                out["anchor"].append(np.full(len(chosen), anchor_key[i]))
                out["positive_id"].append(ids[chosen])
                out["positive_score"].append(score.astype(np.int64))
        return _batch(out, _POSITIVE)

    return work


def _negatives(k: int):
    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {c: [] for c in _NEGATIVE}
        anchor_key, anchor_label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        lows, highs = anchors["low"].to_pylist(), anchors["high"].to_pylist()
        for block, ids, labels, _, at, vectors in _pairs(rows, anchors):
            for i, vector in zip(at, vectors):
                windows = np.array(list(zip(lows[i], highs[i])), np.float64)
                for place, (chosen, score) in enumerate(
                    within(block, vector, labels != anchor_label[i], ids, windows, k)
                ):
                    out["anchor"].append(np.full(len(chosen), anchor_key[i]))
                    out["place"].append(np.full(len(chosen), place))
                    out["negative_id"].append(ids[chosen])
                    out["negative_score"].append(score.astype(np.int64))
        return _batch(out, _NEGATIVE)

    return work


def _schema(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'int' if t == pa.int32() else 'bigint'}" for c, t in kinds.items())


class _Grid:
    """Every block of rows with every block of anchors, each pair one cell."""

    def __init__(self, rows: DataFrame, anchors: int):
        n = rows.count()
        self.down = max(1, math.ceil(n / BLOCK_ROWS))
        self.across = max(1, math.ceil(anchors / BLOCK_ANCHORS))
        # few blocks leave machines idle
        slots = rows.sparkSession.sparkContext.defaultParallelism
        if self.down * self.across < slots:
            self.down = min(max(1, math.ceil(n / 1024)), math.ceil(slots / self.across))
        self.rows = self._dealt(rows, self.down, "down", self.across, "across")

    @staticmethod
    def _dealt(df: DataFrame, own: int, name: str, others: int, other: str) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    def meet(self, anchors: DataFrame, work, kinds: dict[str, pa.DataType]) -> DataFrame:
        dealt = self._dealt(anchors, self.across, "across", self.down, "down")
        return dealt.groupBy("down", "across").cogroup(self.rows.groupBy("down", "across")).applyInArrow(
            work, _schema(kinds)
        )


def _first(df: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, ties by smaller id, with ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), vec_id)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, is_anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_share: int = LEAST_SHARE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows (vec_id, embedding, label) for which ``is_anchor`` holds. A score is
    the inner product with the anchor, components as floor(256 * x), at most 2^20 in size. An
    anchor's positives are its ``positives`` best other rows of its label. For each, the
    ``negatives`` best rows of other labels that score between ``least_share`` hundredths of
    the positive's score and that score are returned. Ties go to the smaller vec_id.

    Rows with a null label or id, a null vector, or a null or non-finite component take no
    part; nor do pairs of different dimension. Repeated rows are rows of their own, as
    anchors, positives and negatives. No rows, no anchors or no fitting negatives give no
    rows. Other columns are ignored.

    Blocks of anchors meet blocks of rows in a grid, so neither is held whole anywhere.
    A cell returns what is best in it, and windows over the cells of an anchor the rest.
    """
    mark = fresh(embeddings, "anchor")
    kept = embeddings.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        whole_numbers(largest=LARGEST).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias(mark), F.monotonically_increasing_id().alias("row"),
    )
    # written once, so the row numbers stay
    kept = materialize(kept, "bond_rows")
    anchors = kept.where(mark).drop(mark)
    grid = _Grid(kept.drop(mark), anchors.count())
    found = grid.meet(anchors, _positives(positives), _POSITIVE)
    chosen = materialize(_first(found, ["anchor"], "positive_score", "positive_id", positives), "positives")
    # negative scores have an empty window
    useful = chosen.where("positive_score >= 0")
    low = F.expr(f"(positive_score * {int(least_share)} + 99) div 100")
    windows = useful.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), F.col("positive_score").alias("high")))).alias("w")
    )
    searched = anchors.join(windows, F.col("row") == F.col("anchor")).select(
        *_NUMBERS, "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high")
    )
    places = windows.select("anchor", F.posexplode("w.rank").alias("place", "rank"))
    places = places.join(useful, ["anchor", "rank"]).select("anchor", "place", "positive_id", "positive_score")
    found = grid.meet(materialize(searched, "windows"), _negatives(negatives), _NEGATIVE)
    ranked = _first(found, ["anchor", "place"], "negative_score", "negative_id", negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(places, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
