import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from addonscope.llm import bilinear as B
from addonscope.llm.queries import op6_language_model


def tokens(text):
    return [*(text or "").encode().lower().split(), B.END]


def check(got, rows):
    learn = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 != 0]
    c = Counter(w for t in learn for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (
            -1 if d is None else d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(tokens(t)),
            sum(c[w] > 0 for w in tokens(t)), n,
            round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6),
        )
        for d, t in rows
    )
    found = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in got
    )
    assert found == want


def test_counts_and_scores(docs, rows):
    """With few words in the head, so that most go through the join."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = B.score(docs.drop("source").withColumnRenamed("lang", "tail"), held_out, 40, 16).collect()
    check(got, [(r[0], r[1]) for r in rows])
    assert all(r.score < 0 for r in got)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_language_model(spark, sf).collect()
    check(got, rows)


def test_model_learns_order_and_is_normalised():
    """Words that follow each other get more than their share; probabilities add up to one."""
    rng = np.random.default_rng(0)
    vocab = B.Vocabulary([b"a", b"b", b"c"], np.array([400, 400, 400]), 1300, 20)
    noise = B.noise_distribution(vocab)
    trainer = B.Trainer(noise)
    for _ in range(400):
        near = rng.integers(0, 3, 256)
        trainer.step(rng.integers(0, 4, 256), near, (near + 1) % 3)
    scorer = B.Scorer(trainer.p)
    n = len(noise)
    for near in range(3):
        each = scorer.log10(np.zeros(n, int), np.full(n, near), np.arange(n))
        assert abs((10**each).sum() - 1) < 1e-4
        assert each.argmax() == (near + 1) % 3


def test_held_out_texts_gain_from_context(spark):
    got = op6_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"))
    score, base = got.first()
    assert score > base


def test_without_training_text(spark, no_docs):
    held_out = F.lit(True)
    assert B.score(no_docs, held_out).count() == 0
    one = spark.createDataFrame([(1, "x y")], "doc_id BIGINT, text STRING")
    row = B.score(one, held_out).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert abs(row.base_score) < 1e-9 and abs(row.score) < 1e-6
