import random

import numpy as np
import pytest

from addonscope.llm import langid
from addonscope.llm.queries import op2_language_id, training


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(training(docs))


def test_learned_languages(model):
    assert model.langs == ("de", "en", "fr")


def test_shares_of_a_mixture(spark, model, rows):
    german, english = rows[2][1], rows[0][1][:100]
    both = spark.createDataFrame([(german + " " + english,)], "text STRING")
    first = langid.identify(both, model).first()
    assert first.lang_pred == "de" and 0.4 < first.score <= 1


def test_every_row_has_a_result(docs, model, rows):
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in model.langs and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 7:
            assert r.lang_pred == r.lang


def test_clashing_columns_and_empty_tables(spark, docs, no_docs, model):
    extra = docs.withColumnsRenamed({"source": "lang_pred", "n_chars": "lang_share"})
    assert langid.kept(extra, model).columns == extra.columns
    assert langid.kept(no_docs, langid.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(no_docs)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op2_language_id(spark, sf).where("held_out").join(docs, "doc_id")
    right, n = held.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert n > 300 and right / n > 0.98


def test_a_mixture_of_six_languages():
    rng = random.Random(2)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    texts = ["".join(rng.choice(a) for _ in range(4000)) for a in alphabets]

    def grams(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return langid.trigrams(raw, np.array([0, len(raw)]))

    counts = np.array([np.bincount(grams(t)[1], minlength=langid.BUCKETS) for t in texts]) + langid.SMOOTHING
    six = langid.Model(tuple(alphabets), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
    shares = langid.infer(*grams(" ".join(t[:600] for t in texts)), 1, six)[0]
    assert np.allclose(shares, 1 / 6, atol=0.03)
    assert (langid.infer(*grams(texts[3][:600]), 1, six)[0] > 0).sum() == 1
