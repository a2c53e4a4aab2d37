import numpy as np
import pyarrow as pa

from addonscope.llm import pstable as P


def brute(vectors):
    n = len(vectors)
    good = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    return near


def component(near, ids):
    label = list(range(len(ids)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == label:
            return [min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))]
        label = new


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    vectors = [list(map(float, np.float32(v))) for v in base]
    for k in range(25):  # a crowd around one vector, and chains that lead away from it
        vectors.append(list(map(float, np.float32(base[0] + 0.12 * rng.standard_normal(16)))))
    for k in range(12):
        vectors.append(list(map(float, np.float32(base[1] + 0.25 * k * base[2]))))
    vectors += [vectors[0]] * 4 + [vectors[30]] * 2
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(100, 100 + len(vectors)))
    rows = spark.createDataFrame(
        [(i, v, "x") for i, v in zip(ids, vectors)], "vec_id BIGINT, embedding ARRAY<FLOAT>, keys STRING"
    ).repartition(3)
    got = {r.vec_id: r for r in P.near_duplicates(rows).collect()}
    near = brute(vectors)
    links = [got[i].n_links for i in ids]
    # tables miss a pair now and then, and never invent one
    assert all(a <= b for a, b in zip(links, near.sum(1))) and sum(links) >= 0.97 * near.sum()
    assert [got[i].component_id for i in ids] == component(near, ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_recall_at_the_threshold():
    """Of pairs with a cosine just over 0.9, over nine tenths share a bucket."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + np.sqrt(1 - 0.81) * b
    assert (P.bucket_keys(a) == P.bucket_keys(c)).any(1).mean() > 0.9
    assert (P.bucket_keys(a) == P.bucket_keys(b)).mean() < 0.001


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = sorted((r.n_links, r.component_id if r.component_id is not None else -1) for r in P.near_duplicates(df).collect())
    assert got == [(0, -1), (2, 1), (2, 1), (2, 1)]
    assert P.near_duplicates(df.limit(0)).count() == 0


def test_equal_keys_of_different_dimensions():
    vectors = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.1, 0.0], [0.0, 0.0, 1.0]]
    vectors = sorted((np.array(v, "<f8").tobytes() for v in vectors), key=len)
    zero = pa.array([0] * 5, pa.int32())
    keys = pa.array([[7] * P.TABLES] * 5, pa.list_(pa.int32()))
    table = pa.table({
        "dim": pa.array([len(v) for v in vectors], pa.int32()), "place": zero, "key": pa.array([7] * 5, pa.int32()),
        "low": zero, "high": zero, "part": zero, "name": pa.array([b"%d" % i for i in range(5)]),
        "copies": pa.array([1] * 5, pa.int64()), "keys": keys, "vector": pa.array(vectors),
    })
    links = P._links(table, "<f8").to_pydict()
    assert dict(zip(links["name"], links["links"])) == {b"0": 1, b"1": 1, b"3": 1, b"4": 1}
