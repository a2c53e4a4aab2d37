import random

import corpus_pipeline as C
import numpy as np
from addonscope.llm import resemblance as R
from addonscope.session import small_batches


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(seed=3):
    """Texts of 200 words and copies with 3 words changed, at 0.8 similarity or more, and others below."""
    rng = random.Random(seed)
    out = []
    for i in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        out.append((100 * i, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(200), 3 if j < 3 else 40):
                copy[at] = f"new{i}x{j}x{at}"
            out.append((100 * i + j, " ".join(copy)))
    return out


def components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def check(spark):
    rows = edited()
    docs = spark.createDataFrame(rows + [(7, None), (8, " "), (9, "a b")], "doc_id BIGINT, text STRING").repartition(3)
    keyed = docs.withColumn("row", R.row_key()).collect()
    place = {r.row: i for i, r in enumerate(keyed)}
    label = {i: i for i in place.values()}
    for r in R.similar_rows(docs).collect():
        old, new = label[place[r.a]], label[place[r.b]]
        label = {i: new if x == old else x for i, x in label.items()}
    groups = {}
    for i, x in label.items():
        groups.setdefault(x, set()).add(i)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == components([r.text for r in keyed])


def test_links_against_all_pairs(spark):
    check(spark)


def test_links_of_split_clusters(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_ROWS", 1)
    monkeypatch.setattr(R, "COLUMNS", 7)
    check(spark)


def test_edited_copies_do_not_go_through_the_pipeline(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    kept = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows if i % 100 in (0, 3)}


def test_bands_meet_at_the_threshold():
    """Sets at similarity 0.8 share some key."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        pair = np.concatenate([x[:85], x[5:]])
        keys = R.band_keys(pair, np.array([0, 85]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_texts_come_to_python_in_small_batches(spark, monkeypatch):
    """Both passes over the texts hold little of them at a time; the session's setting stays."""
    sizes = []
    write = R.materialize

    def seen(df, name):
        sizes.append((name, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return write(df, name)

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for module in (C.anchors, R):
        monkeypatch.setattr(module, "materialize", seen)
    docs = spark.createDataFrame(edited(), "doc_id BIGINT, text STRING")
    C.near_duplicates(spark, docs, "").collect()
    assert {n for n, size in sizes if size == str(1 << 20)} == {"fingerprints", "sketches", "similar"}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_batches_are_cut_by_bytes(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 1000) AS text")

    def count(batches):
        for batch in batches:
            yield R.pa.RecordBatch.from_arrays([R.pa.array([batch.num_rows])], names=["n"])

    with small_batches(spark):
        sizes = [r.n for r in rows.mapInArrow(count, "n bigint").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1200
