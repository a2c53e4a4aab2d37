import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from addonscope.llm import bond

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, every=10, positives=5, negatives=5, share=80):
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, anchor in enumerate(kept):
        if anchor[0] % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(anchor[1], r[1])), r[0], r[2])
            for b, r in enumerate(kept) if b != a and len(r[1]) == len(anchor[1])
        )
        same = [s for s in scored if s[2] == anchor[2]][:positives]
        for p in same:
            fit = [s for s in scored if s[2] != anchor[2] and share * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            out += [(anchor[0], p[1], n + 1, s[1], -p[0], -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


def rows_of(seed, n, dim=24, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dim))
    return [
        (int(i), [float(x) for x in centres[i % 5] + rng.normal(0, 0.15, dim)], int(rng.integers(labels))) for i in range(n)
    ]


ODD = [
    (None, [0.1] * 24, 1), (500, None, 1), (510, [0.1] * 23 + [None], 1), (520, [float("nan")] + [0.1] * 23, 2),
    (530, [float("-inf")] + [0.1] * 23, 2), (540, [0.5] * 8, 2), (541, [0.5] * 8, 2), (542, [0.45] * 8, 1), (550, [], 1),
    (551, [], 1), (552, [], 2), (560, [0.1] * 24, None), (570, [0.0] * 24, 1), (571, [-0.0] * 24, 1),
]


def found(df, **options):
    got = bond.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("rows", [
    rows_of(1, 500) + ODD, rows_of(2, 60) * 3, [(i, [0.25] * 24, i % 2) for i in range(80)],
    [(i, [-0.2 if i % 2 else 0.2] * 24, 1 if i < 40 else 2) for i in range(80)], rows_of(3, 40, labels=1), ODD, [],
])
def test_negatives_are_those_of_plain_search(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df) == brute(rows)


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(bond, "BLOCK_ROWS", 60)
    monkeypatch.setattr(bond, "BLOCK_ANCHORS", 9)
    rows = rows_of(7, 400) + ODD
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_other_numbers_and_clashing_columns(spark):
    rows = rows_of(8, 200)
    df = spark.createDataFrame([(*r, 1, 2, True) for r in rows], SCHEMA + ", row INT, rank INT, anchor BOOLEAN")
    assert found(df, positives=3, negatives=2, least_share=55) == brute(rows, 10, 3, 2, 55)


def test_scan_reads_fewer_rows_than_it_has():
    """The bitmap shrinks: late dimensions are read for few rows, and scores stay exact."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (5000, 32)) * np.linspace(3, 0.1, 32).round(1)
    vectors = np.floor(vectors)
    block, anchor = bond.Block(vectors), vectors[17]
    left = []

    def narrow(least, most):
        stay = most >= np.partition(least, -5)[-5] if len(least) > 5 else np.ones(len(least), bool)
        left.append(int(stay.sum()))
        return stay

    rows, score = block.scan(anchor, np.ones(5000, bool), narrow)
    assert (score == vectors[rows] @ anchor).all() and left[-2] < 500
