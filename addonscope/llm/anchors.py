"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint is 64 bits over 4-word shingles. Two halves of 32 bits are covered on their
own: 4 differing bits leave at most 2 in the lower half or at most 1 in the upper one.
The code of a half is the direct sum of the binary Golay code on 23 bits (perfect,
covering radius 3), the Hamming code on 7 bits (perfect, radius 1) and all words on the
last 2 bits: 2^18 anchors. A fingerprint's home is its nearest anchor; it is a guest at
every anchor within covering radius plus threshold of it. Whoever is near enough to a
fingerprint is a guest at its home, so comparing homes with guests per anchor finds every
link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import chunks, forest, row_key, starts_of, text_bytes, whole_groups
from addonscope.llm.components import connected_components
from addonscope.session import materialize, small_batches

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: (shift of the half, differing bits it may hold); one more than each sums to MAX_BITS + 1.
HALVES = ((0, 2), (32, 1))
#: Homes at one anchor beyond which the anchor is split; guests go to each part.
ANCHOR_ROWS = 4096
#: Pairs that are compared at a time, and fingerprints that are placed at a time (about 70 rows each).
PAIRS, PLACED = 1 << 19, 1024

# --- fingerprints ------------------------------------------------------------------


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the words of ``text``; the whole text where it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])]


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_bytes(batch["text"])
        found = np.zeros(batch.num_rows, np.uint64)
        for first, last in chunks(at):
            each = [shingle_hashes(raw[at[i] : at[i + 1]].tobytes()) for i in range(first, last)]
            sizes = np.array([len(x) for x in each])
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            values = np.fromiter((h for x in each for h in x), "<u8", int(sizes.sum()))
            # whole documents at a time, so that the bits of a part stay small
            counts = np.zeros((len(full), 64), np.int64)
            bounds = np.r_[0, np.cumsum(sizes[full])]
            for a, b in chunks(bounds, 1 << 16):
                bits = np.unpackbits(
                    values[bounds[a] : bounds[b]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
                )
                counts[a:b] = np.add.reduceat(bits, bounds[a:b] - bounds[a], axis=0, dtype=np.int64)
            ones = (2 * counts > sizes[full][:, None]).astype(np.uint8)
            found[first + full] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row"], pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) of every document; null or wordless texts have fingerprint zero."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(
        fingerprint_batches, f"doc_id {kind}, row bigint, fp bigint"
    )


# --- the covering code -------------------------------------------------------------


def _weights(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-bit words of weight up to ``most``, and their weights."""
    words = [sum(1 << i for i in at) for k in range(most + 1) for at in combinations(range(n), k)]
    sizes = [k for k in range(most + 1) for _ in combinations(range(n), k)]
    return np.array(words, np.int64), np.array(sizes)


def _golay_columns() -> list[int]:
    """Remainders of x^i by the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    generator, value, out = 0b101011100011, 1, []
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value >> 11:
            value ^= generator
    return out


def _syndromes(words: np.ndarray, columns: list[int]) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for i, c in enumerate(columns):
        out ^= np.where(words >> i & 1, c, 0)
    return out


_HAMMING = list(range(1, 8))


def half_syndromes(half: np.ndarray) -> np.ndarray:
    """Syndrome of 32-bit words: 11 bits of the Golay part, 3 of the Hamming part."""
    return _syndromes(half & 0x7FFFFF, _golay_columns()) | _syndromes(half >> 23 & 0x7F, _HAMMING) << 11


@lru_cache
def offsets_to_anchors(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome, the differences to the anchors where a word is a guest.

    (bounds by syndrome, differences, whether the anchor is the home). What a part
    exceeds its own radius by must come from differing bits, so the excess of all three
    parts together is at most ``threshold``.
    """
    parts = []
    for n, radius, shift, columns, place in (
        (23, 3, 0, _golay_columns(), 0), (7, 1, 23, _HAMMING, 11), (2, 0, 30, None, 0),
    ):
        words, sizes = _weights(n, min(n, radius + threshold))
        syndrome = _syndromes(words, columns) << place if columns else np.zeros(len(words), np.int64)
        parts.append((words << shift, syndrome, np.maximum(0, sizes - radius)))
    words, syndrome, excess = parts[0]
    for w, s, e in parts[1:]:
        fits = (excess[:, None] + e[None, :] <= threshold).nonzero()
        words, syndrome, excess = (
            words[fits[0]] | w[fits[1]], syndrome[fits[0]] | s[fits[1]], excess[fits[0]] + e[fits[1]],
        )
    order = np.lexsort((words, excess, syndrome))
    words, syndrome, excess = words[order], syndrome[order], excess[order]
    return np.searchsorted(syndrome, np.arange((1 << 14) + 1)), words, excess == 0


def guests(fp: np.ndarray, shift: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, home) for each anchor of one half; homes are one each."""
    half = fp.view(np.uint64).astype(np.uint64) >> np.uint64(shift) & np.uint64(0xFFFFFFFF)
    half = half.astype(np.int64)
    bounds, words, home = offsets_to_anchors(threshold)
    s = half_syndromes(half)
    sizes = bounds[s + 1] - bounds[s]
    index = np.repeat(np.arange(len(fp)), sizes)
    entry = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[s], sizes)
    return index, half[index] ^ words[entry] | shift << 32, home[entry]


def _parts(anchor: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    parts = np.ones(len(anchor), np.int64)
    if hot:
        names = np.array(sorted(hot))
        at = np.minimum(np.searchsorted(names, anchor), len(names) - 1)
        found = names[at] == anchor
        parts[found] = np.array([hot[k] for k in names.tolist()])[at[found]]
    return parts


def anchor_rows(hot: dict[int, int]):
    """Rows (anchor, part, fp, home): each fingerprint at all its anchors, in every part."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            for low in range(0, len(fps), PLACED):
                fp = fps[low : low + PLACED]
                for shift, threshold in HALVES:
                    index, anchor, home = guests(fp, shift, threshold)
                    parts = _parts(anchor, hot)
                    each = np.repeat(np.arange(len(index)), parts)
                    part = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
                    value = fp[index[each]]
                    own = home[each] & (part == (value ^ value >> 32) % parts[each])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[each]), pa.array(part.astype(np.int32)), pa.array(value), pa.array(own)],
                        names=["anchor", "part", "fp", "home"],
                    )

    return place


def home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch["fp"].to_numpy()
        for shift, _ in HALVES:
            yield pa.RecordBatch.from_arrays([pa.array(guests(fp, shift, 0)[1])], names=["anchor"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per anchor, as (member, smallest member) of what hangs together there."""
    for table in whole_groups(batches, ["anchor", "part"]):
        anchor, part, fp = (table[c].to_numpy() for c in ("anchor", "part", "fp"))
        starts = starts_of(anchor, part)
        sizes = np.diff(np.r_[starts, len(fp)])
        group = np.repeat(np.arange(len(starts)), sizes)
        homes = np.flatnonzero(table["home"].to_numpy(zero_copy_only=False))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in chunks(np.r_[0, np.cumsum(sizes[group[homes]])], PAIRS):
            own = homes[a:b]
            n = sizes[group[own]]
            x = np.repeat(own, n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[own]], n)
            near = (fp[x] < fp[y]) & (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= MAX_BITS)
            found.append(forest(fp[x[near]], fp[y[near]]))
        child, root = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (list(zip(*found)) or ([], [])))
        child, root = forest(child, root)
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(child)], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that are near.

    Near copies of one text share anchors, so the links found at an anchor are cut to a
    tree; all pairs are compared, but a group of n gives n - 1 rows, not n * n. The list
    of crowded anchors has at most one entry per anchor of the code, 2^19.
    """
    crowded = (
        distinct.mapInArrow(home_rows, "anchor bigint").groupBy("anchor").count()
        .where(F.col("count") > ANCHOR_ROWS).collect()
    )
    hot = {r["anchor"]: -(-r["count"] // ANCHOR_ROWS) for r in crowded}
    rows = distinct.mapInArrow(anchor_rows(hot), "anchor bigint, part int, fp bigint, home boolean")
    placed = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return placed.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, row, fp, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of 4 or fewer differing bits lead
    to. Texts that are null or have no word have fingerprint zero and link with each
    other. Rows with equal fingerprints are one node, however many they are. A component
    without any id has a null component_id. Repeated rows are kept. ``more`` gives further
    links (a, b) between fingerprints, from the rows (doc_id, row, fp).
    """
    with small_batches(docs.sparkSession):
        marked = materialize(fingerprints(docs), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "distinct_fingerprints")
    near = links(distinct.select("fp"))
    found = connected_components(near.unionByName(more(marked)) if more else near)
    root = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    smallest = root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = root.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def representatives(marked: DataFrame) -> DataFrame:
    """Row key of one document for each component: of its smallest doc_id, then the smallest key."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    return marked.groupBy("root").agg(first.alias("x")).select(F.col("x.row").alias("row"))
