"""Language identification by inference of a mixture of languages.

A language is a distribution over hashed byte trigrams, counted over all labelled
training texts. A document's trigrams come from a mixture of languages whose shares are
estimated by expectation-maximisation. The set of languages starts with the likeliest one
and takes in another while that raises the penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import chunks, fresh, text_bytes

#: Trigrams are hashed to this many numbers; a model has one count per language and number.
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Steps of expectation-maximisation for one set of languages.
STEPS = 12
#: Trigrams overlap, so n of them tell about as much as n / 3 that do not.
OVERLAP = 3.0

UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each trigram; ASCII is lower-cased, its non-letters are blanks."""
    n = len(raw)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[raw].astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = (doc[:-2] == doc[2:]) & (code != 0x202020)
    mixed = code[keep] * np.uint32(0x9E3779B1)
    return doc[:-2][keep], (mixed >> np.uint32(17)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of all rows of one task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, at = text_bytes(batch["text"])
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        for first, last in chunks(at):
            doc, bucket = trigrams(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            for lang in set(langs[first:last]):
                own = (langs[first:last] == lang)[doc]
                counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts += np.bincount(bucket[own], minlength=BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
            names=["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class Model:
    """Log-probability of each bucket in each language; rows follow ``langs``."""

    langs: tuple[str, ...]
    log_p: np.ndarray


def fit(labelled: DataFrame) -> Model:
    """Counts the trigrams of all rows of ``labelled`` (text, lang); null languages are left out.

    What reaches the driver is one number per language and bucket, whatever the input.
    """
    rows = labelled.where("lang is not null").select("text", "lang")
    found = rows.mapInArrow(_counts, "lang string, bucket int, n bigint")
    found = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(set(found["lang"])))
    counts = np.zeros((len(langs), BUCKETS))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[found["lang"].map(place).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"].to_numpy(float)
    p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model(langs, np.log(p).astype(np.float32))


def _mixture(x, at, p, chosen, shares):
    """EM for documents that are runs of distinct trigrams; ``p`` is trigrams x languages.

    Returns the shares, the log-likelihood, and how fast it rises toward each language.
    """
    sizes = np.diff(at)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.add.reduceat(x, at[:-1])
    for step in range(STEPS + 1):
        mix = np.einsum("ij,ij->i", p, shares[doc])
        rise = np.add.reduceat(p * (x / mix)[:, None], at[:-1], axis=0) / total[:, None]
        if step < STEPS:
            shares = np.where(chosen, shares * rise, 0)
            shares /= shares.sum(1, keepdims=True)
    return shares, np.add.reduceat(x * np.log(mix), at[:-1]), rise


def infer(doc: np.ndarray, bucket: np.ndarray, n_docs: int, model: Model) -> np.ndarray:
    """Share of each language in each document; rows of zeros where a document has no trigram."""
    out = np.zeros((n_docs, len(model.langs)))
    if not len(doc) or not model.langs:
        return out
    cell, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, x = cell // BUCKETS, count.astype(float)
    log_p = model.log_p[:, cell % BUCKETS].T.astype(float)
    names, at = np.unique(doc, return_index=True)
    at = np.r_[at, len(doc)]
    alone = np.add.reduceat(x[:, None] * log_p, at[:-1], axis=0)
    shares = np.zeros((len(names), len(model.langs)))
    shares[np.arange(len(names)), alone.argmax(1)] = 1
    best = alone.max(1)
    p = np.exp(log_p)
    active = np.arange(len(names))
    for _ in range(len(model.langs) - 1):
        rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in active])
        sizes = at[active + 1] - at[active]
        own_at = np.r_[0, np.cumsum(sizes)]
        own_x, own_p = x[rows], p[rows]
        total = np.add.reduceat(own_x, own_at[:-1])
        mix = np.einsum("ij,ij->i", own_p, np.repeat(shares[active], sizes, axis=0))
        rise = np.add.reduceat(own_p * (own_x / mix)[:, None], own_at[:-1], axis=0) / total[:, None]
        chosen = shares[active] > 0
        new = np.where(chosen, -np.inf, rise).argmax(1)
        chosen[np.arange(len(active)), new] = True
        start = np.where(chosen, np.maximum(shares[active] * 0.8, 0.2), 0)
        tried, value, _ = _mixture(own_x, own_at, own_p, chosen, start / start.sum(1, keepdims=True))
        gain = (value - best[active]) / OVERLAP - 0.5 * np.log(np.maximum(total / OVERLAP, 2))
        better = gain > 0
        active = active[better]
        if not len(active):
            break
        shares[active], best[active] = tried[better], value[better]
    out[names] = shares
    return out


def _predictor(model: Model, text: str):
    langs = np.array([*model.langs, UNDETERMINED], dtype=object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch[text])
            shares = np.zeros((batch.num_rows, len(model.langs)))
            for first, last in chunks(at):
                doc, bucket = trigrams(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                shares[first:last] = infer(doc, bucket, last - first, model)
            best = shares.argmax(1) if len(model.langs) else np.zeros(len(shares), int)
            score = shares.max(1) if len(model.langs) else np.zeros(len(shares))
            names = langs[best] if len(model.langs) else np.full(len(shares), UNDETERMINED, object)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(score)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the main language of each text and its share of the text (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    where no language was learned. A text with letters but no trigram (one or two
    letters) gets the language with the smallest name and score 0. Repeated rows get
    equal results. All columns of ``docs`` are kept; ``lang`` and ``score`` name the two
    new ones.
    """
    text = docs.select("text").columns[0]
    schema = docs.select("*").schema.simpleString()
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(text)}"
    schema = ", ".join(f"{c} {k}" for c, k in inner.dtypes) + ", lang_pred string, score double"
    found = inner.mapInArrow(_predictor(model, own), schema)
    letters = F.coalesce(F.col(own).rlike(r"\p{L}"), F.lit(False))
    found = found.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNDETERMINED))
    found = found.withColumn("score", F.when(letters, F.col("score")).otherwise(0.0))
    return found.toDF(*names, lang, score)


def kept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows whose text has a main language with a share of at least ``least``."""
    lang = fresh(docs, "lang_pred")
    share = fresh(docs, "lang_share")
    found = identify(docs, model, lang, share)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(share) >= least)).drop(lang, share)
