import hashlib
import math

import numpy as np
import pytest

from addonscope.llm import orchard

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes, errors and codebooks by plain loops over all entries."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    fit = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    dim = len(min(fit, key=key)[1]) if fit else -1
    fit = [r for r in kept if len(r[1]) == dim]
    width = dim // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in sorted(fit, key=key)[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(cut(v, p), b)), i) for i, b in enumerate(books[p]))

    for _ in range(rounds if fit else 0):
        moved = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in fit:
                own[near(r[1], p)[1]].append(cut(r[1], p))
            moved.append([[sum(c) // len(o) for c in zip(*o)] if o else b for o, b in zip(own, books[p])])
        books = moved
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest() if fit else None
    coded = []
    for i, v, label in kept:
        if len(v) != dim:
            coded.append((i, None, None, label))
            continue
        found = [near(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    totals = {}
    for _, _, error, label in coded:
        if error is not None:
            totals[label] = totals.get(label, 0) + error
    return sorted(((i, c, e, totals.get(label), sha) for i, c, e, label in coded), key=str)


def rows_of(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (9, dim))
    return [
        (int(i), [float(x) for x in centres[i % 9] + rng.normal(0, 0.1, dim)], None if i % 11 == 0 else int(i % 4))
        for i in range(n)
    ]


ODD = [
    (None, [0.1] * 32, 1), (500, None, 1), (501, [0.1] * 31 + [None], 1), (502, [float("nan")] + [0.1] * 31, 2),
    (503, [float("inf")] + [0.1] * 31, 2), (504, [0.5] * 48, 2), (505, [], 77), (506, [0.2] * 7, 3), (507, [-0.003] * 32, 3),
]


@pytest.mark.parametrize("rows", [
    rows_of(1, 400) + ODD, rows_of(2, 20) + ODD[:4], rows_of(3, 100)[:50] * 3, [(i, [0.25] * 16, 1) for i in range(90)], ODD[4:6], [],
])
def test_codes_are_those_of_plain_search(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = orchard.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_other_parts_entries_rounds_and_clashing_columns(spark):
    rows = rows_of(5, 150)
    df = spark.createDataFrame(
        [(*r, 1, "c", 2) for r in rows], SCHEMA + ", share INT, code STRING, error INT"
    )
    got = orchard.compress(df, parts=4, entries=20, rounds=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4, 20, 3)


def test_search_measures_few_entries_and_breaks_ties_low():
    rng = np.random.default_rng(0)
    for k, width, spread in ((64, 4, 60), (64, 1, 3), (1, 2, 9), (200, 3, 5)):
        entries = rng.integers(-spread, spread, (k, width))
        points = rng.integers(-spread, spread, (3000, width))
        at, distance = orchard.nearest(points, entries, *orchard.neighbour_lists(entries))
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (distance == every.min(1)).all()
