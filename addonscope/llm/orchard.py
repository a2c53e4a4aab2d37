"""Codes of vectors by product quantisation; nearest entries by Orchard's search.

A vector of integers is cut into equal parts, and each part position has a codebook. The
nearest entry of a part is found by walking neighbour lists: for every entry the others,
by distance. From the current entry its list is read outwards; a nearer entry becomes the
current one and its list is read instead. Entries that were measured once are marked and
not measured again. What lies more than twice the current distance from the current entry
cannot be nearer, by the triangle inequality, and ends the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.session import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Integers stay within this, so that squared distances of 4,096 components fit 64 bits.
LARGEST = 1 << 24
#: Vectors that numpy works on at a time.
ROWS = 1 << 13
#: Shares into which the rows of a label are dealt to meet the label's total.
SHARES = 32


def whole_numbers(vector: str = "embedding", largest: int = LARGEST) -> F.Column:
    """floor(256 * x) of every component, kept within ``largest``; the vector has no null or non-finite one."""
    bounded = f"greatest(least({SCALE}D * x, {largest}D), {-largest}D)"
    return F.expr(f"transform({vector}, x -> cast(floor({bounded}) as int))")


def usable(vector: str = "embedding") -> F.Column:
    """Whether the vector is there and all components are finite numbers."""
    return F.col(vector).isNotNull() & F.expr(
        f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    )


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry all entries by squared distance, ties by index, and those distances."""
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, 1)


def nearest(points: np.ndarray, entries: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every point, ties to the lower index, and the squared distance.

    All points walk at once; each step reads one place of each point's current list.
    """
    n, k = len(points), len(entries)
    # start at the entry whose first component is about the point's
    by_first = np.argsort(entries[:, 0], kind="stable")
    at = by_first[np.minimum(np.searchsorted(entries[by_first, 0], points[:, 0]), k - 1)]
    best = ((points - entries[at]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), at] = True
    place = np.zeros(n, np.int64)
    live = np.arange(n)
    while True:
        live = live[place[live] < k]
        live = live[gaps[at[live], place[live]] <= 4 * best[live]]
        if not len(live):
            return at, best
        other = order[at[live], place[live]]
        place[live] += 1
        new = ~seen[live, other]
        rows, other = live[new], other[new]
        seen[rows, other] = True
        distance = ((points[rows] - entries[other]) ** 2).sum(1)
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (other < at[rows]))
        rows = rows[nearer]
        at[rows], best[rows], place[rows] = other[nearer], distance[nearer], 0


class Codebooks:
    """Entries of every part position, (parts, entries, width), with their neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.lists = [neighbour_lists(e) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, parts): indexes of the nearest entries, and their squared distances."""
        parts, _, width = self.entries.shape
        found = np.empty((len(vectors), parts), np.int64)
        error = np.empty((len(vectors), parts), np.int64)
        for p in range(parts):
            points = vectors[:, p * width : (p + 1) * width]
            found[:, p], error[:, p] = nearest(points, self.entries[p], *self.lists[p])
        return found, error

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(books: Codebooks):
    """(part, entry, n, sums): one row for each entry that the task's parts chose."""
    parts, k, width = books.entries.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                vectors = _matrix(batch["vector"].slice(first, ROWS), parts * width)
                found, _ = books.assign(vectors)
                for p in range(parts):
                    counts[p] += np.bincount(found[:, p], minlength=k)
                    np.add.at(sums[p], found[:, p], vectors[:, p * width : (p + 1) * width])
        p, e = np.nonzero(counts)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists],
            names=["part", "entry", "n", "sums"],
        )

    return work


def _codes(books: Codebooks):
    parts, _, width = books.entries.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                found, error = books.assign(_matrix(part["vector"], parts * width))
                codes = ["".join(row) for row in digits[found].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["label"], pa.array(codes, pa.string()), pa.array(error.sum(1))],
                    names=["vec_id", "label", "code", "error"],
                )

    return work


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the rows (vec_id, vector), all of one dimension, a multiple of ``parts``.

    They start as the parts of the rows with the smallest ids (nulls last, ties by vector)
    and move ``rounds`` times to the floored means of the parts next to them; an entry that
    nothing is next to stays. Only sums for each entry leave the tasks, and only codebooks,
    whose size does not depend on the rows, reach the driver. Without rows there are none.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    start = np.array([r["vector"] for r in first], np.int64)
    width = start.shape[1] // parts
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).swapaxes(0, 1)))
    columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    for _ in range(rounds):
        each = vectors.select("vector").mapInArrow(_sums(books), "part int, entry int, n bigint, sums array<bigint>")
        moved = books.entries.copy()
        for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():
            moved[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
        books = Codebooks(moved)
    return books


def compress(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the usable rows of (vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are dropped. Each
    component becomes floor(256 * x), at most 2^24 in size. Repeated rows each keep a row;
    fewer rows than entries give smaller codebooks. All codebooks have the dimension of the
    smallest id (then vector) among the vectors of at least one component whose number of
    components is a multiple of ``parts``; rows of another dimension have no code and no
    error. ``label_error`` sums the errors of equal labels, nulls together; it is null where
    no row of the label has one. No rows give no rows. Other columns are ignored.
    """
    kept = materialize(
        embeddings.where(usable()).select("vec_id", "label", whole_numbers().alias("vector")), "whole_numbers"
    )
    dims = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = dims.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).limit(1).collect()
    dim = first[0][0] if first else -1
    fitting = kept.where(F.size("vector") == dim)
    books = train(fitting.select("vec_id", "vector"), parts, entries, rounds)
    types = dict(embeddings.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint"
    rest = kept.where(F.size("vector") != dim).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")
    )
    coded = rest
    digest = None
    if books:
        coded = fitting.mapInArrow(_codes(books), schema).unionByName(rest)
        digest = hashlib.sha256(books.text().encode()).hexdigest()
    coded = materialize(coded, "vector_codes")
    # a label may hold a large part of all rows: its total meets them in shares
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    totals = totals.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = coded.withColumn("share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SHARES)).cast("int")).alias("r")
    joined = rows.join(
        totals.alias("t"), (F.col("r.share") == F.col("t.share")) & F.col("r.label").eqNullSafe(F.col("t.label"))
    )
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
