"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors of length 1 with cosine c are sqrt(2 - 2c) apart. A table hashes a vector by
several Gaussian projections, shifted and cut into cells; near vectors meet in some table
with high probability. Whoever meets is checked exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import forest, starts_of, whole_groups
from addonscope.llm.components import connected_components
from addonscope.session import materialize

COSINE = 0.9
#: At cosine 0.9 a projection agrees with probability 0.82, and some table in all with 0.96;
#: unrelated vectors agree in all projections of a table with probability 0.0002.
TABLES, PROJECTIONS, WIDTH = 32, 12, 2.0
SEED = 20240229
#: Members of a bucket that one task compares with each other; larger ones are split into
#: cells, one for each pair of parts.
BUCKET_ROWS = 1024
#: What the members of a cell have in common; keys of different dimensions may be equal.
CELL = ["dim", "place", "key", "low", "high"]


def hash_family(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dim, tables * projections) and shifts, the same for every task."""
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def bucket_keys(units: np.ndarray) -> np.ndarray:
    """(vectors, tables): a 32-bit key of each vector's cell in each table."""
    a, b = hash_family(units.shape[1])
    cells = np.floor((units @ a + b) / WIDTH).astype(np.int64).reshape(len(units), TABLES, PROJECTIONS)
    key = np.full(cells.shape[:2], units.shape[1], np.uint64)
    for i in range(PROJECTIONS):
        key = (key ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors, by dimension."""
    n = len(column)
    sizes = np.array([len(v) if v is not None else 0 for v in column.to_pylist()]) if n else np.zeros(0, int)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        # a null component reads as NaN
        good = np.isfinite(values).all(1) & (values != 0).any(1)
        yield rows[good], values[good]


def _units(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _named(kind: str):
    """(vec_id, vector, name): the usable vectors as bytes of ``kind`` and their digest; else nulls."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors: list[bytes | None] = [None] * batch.num_rows
            for rows, values in _vectors(batch["embedding"]):
                for i, v in zip(rows, (values + 0.0).astype(kind)):  # -0.0 is 0.0
                    vectors[i] = v.tobytes()
            names = [None if v is None else hashlib.md5(v).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(vectors, pa.binary()), pa.array(names, pa.binary())],
                names=["vec_id", "vector", "name"],
            )

    return work


def _by_dim(vectors: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(vectors[i] for i in rows), kind).astype(float).reshape(len(rows), -1)


def _hashed(kind: str):
    """(name, dim, keys): the bytes of a vector and its bucket key in each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                names, vectors = part["name"], part["vector"].to_pylist()
                keys = np.zeros((len(vectors), TABLES), np.int32)
                for rows, values in _by_dim(vectors, kind):
                    keys[rows] = bucket_keys(_units(values))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keys) + 1) * TABLES, pa.int32()), pa.array(keys.ravel())
                )
                dims = pa.array([len(v) for v in vectors], pa.int32())
                yield pa.RecordBatch.from_arrays([names, dims, lists], names=["name", "dim", "keys"])

    return work


def _compare(kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CELL, 1 << 14):
            yield _links(table, kind)

    return work


def _links(table: pa.Table, kind: str) -> pa.RecordBatch:
    """(name, links, root) of whole cells: copies linked here first, and one member linked.

    Cells hold vectors of one dimension.
    """
    place, low, high = (table[c].to_numpy() for c in ("place", "low", "high"))
    part, copies = table["part"].to_numpy(), table["copies"].to_numpy()
    names = table["name"].to_pylist()
    vectors = table["vector"].to_pylist()
    flat = table["keys"].combine_chunks().flatten().to_numpy()
    keys = flat.reshape(len(names), TABLES)
    starts = starts_of(*(table[c].to_numpy() for c in CELL))
    links = np.zeros(len(names), np.int64)
    xs, ys = [], []
    for a, b in zip(starts, np.r_[starts[1:], len(names)]):
        units = _units(np.frombuffer(b"".join(vectors[a:b]), kind).astype(float).reshape(b - a, -1))
        # two parts meet in a cell: only pairs across them are new
        own, other = (np.flatnonzero(part[a:b] == p) for p in (low[a], high[a]))
        i, j = np.nonzero(units[own] @ units[other].T >= COSINE - 1e-9)
        i, j = own[i], other[j]
        if low[a] == high[a]:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", units[i], units[j]) >= COSINE
        i, j = i[exact] + a, j[exact] + a
        # a pair counts in the first table where it meets
        new = ~(keys[i, : place[a]] == keys[j, : place[a]]).any(1)
        np.add.at(links, i[new], copies[j[new]])
        np.add.at(links, j[new], copies[i[new]])
        child, root = forest(i, j)
        xs.append(child)
        ys.append(root)
    child, root = np.concatenate(xs), np.concatenate(ys)
    roots: list[bytes | None] = [None] * len(names)
    for c, r in zip(child, root):
        roots[c] = names[r]
    some = np.flatnonzero((links > 0) | np.array([r is not None for r in roots]))
    return pa.RecordBatch.from_arrays(
        [
            table["name"].combine_chunks().take(pa.array(some)), pa.array(links[some]),
            pa.array([roots[i] for i in some], pa.binary()),
        ],
        names=["name", "links", "root"],
    )


def _cells(hashed: DataFrame) -> DataFrame:
    """(name, dim, place, key, part, low, high): where each vector meets others.

    Buckets with one member drop out. One with more than ``BUCKET_ROWS`` is cut into
    parts, and every pair of parts meets in a cell of its own.
    """
    each = hashed.select("name", "dim", F.posexplode("keys").alias("place", "key"))
    sizes = each.groupBy("dim", "place", "key").count().where("count > 1")
    parts = F.ceil(F.col("count") / BUCKET_ROWS).cast("int")
    met = each.join(sizes.select("dim", "place", "key", parts.alias("parts")), ["dim", "place", "key"])
    met = met.withColumn("part", F.pmod(F.xxhash64("name"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(
        "name", "dim", "place", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    )


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding).

    Rows with cosine of at least 0.9 in double precision link; ``n_links`` counts the
    other rows a row links with, equal ones included. Equal vectors are one node with a
    count, however many they are. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different dimension.
    ``component_id`` is the smallest vec_id that links lead to; without any id it is null.
    """
    types = dict(embeddings.dtypes)
    kind = "<f4" if types["embedding"] == "array<float>" else "<f8"
    named = embeddings.select("vec_id", "embedding").mapInArrow(
        _named(kind), f"vec_id {types['vec_id']}, vector binary, name binary"
    )
    named = materialize(named, "vectors")
    usable = named.where("name is not null").groupBy("name").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
    )
    classes = materialize(usable, "vector_classes")
    hashed = materialize(classes.select("name", "vector").mapInArrow(_hashed(kind), "name binary, dim int, keys array<int>"), "bucket_keys")
    placed = (
        _cells(hashed).join(hashed.drop("dim"), "name").join(classes.select("name", "copies", "vector"), "name")
        .repartition(*CELL).sortWithinPartitions(*CELL)
        .select(*CELL, "part", "name", "copies", "keys", "vector")
    )
    found = materialize(placed.mapInArrow(_compare(kind), "name binary, links bigint, root binary"), "vector_links")
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    edges = found.where("root is not null").select(
        F.least("name", "root").alias("a"), F.greatest("name", "root").alias("b")
    )
    roots = connected_components(edges)
    c = classes.select("name", "first", "copies")
    joined = c.join(counts, "name", "left").join(roots, c["name"] == roots["node"], "left").select(
        "name", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "name").alias("component"),
    )
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    known = joined.join(smallest, "component").select("name", "n_links", "component_id")
    rows = named.select("vec_id", "name").join(known, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
