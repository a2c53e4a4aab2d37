"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Words are counted over the whole training corpus. The most frequent ones are the classes
of a log-bilinear model: the vectors of the two preceding words, each scaled by the
weights of its place, add up to a prediction that is compared with the vector of every
class. All other words are one more class, shared among them by their counts. Training
tells words from noise drawn by frequency; scoring divides by the exact sum over classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import chunks, row_key, text_bytes
from addonscope.session import materialize

#: Frequent words that tasks hold themselves; all others meet their counts in a join.
HEAD = 1 << 17
#: Classes of the model, that of all other words included; size of a vector; noise words a batch.
CLASSES, DIM, NOISE = 1024, 16, 24
BATCH, RATE = 2048, 0.1
#: The end of a text; no word holds a line break.
END = b"\n"
ALPHA = 0.1
#: Words a task counts before it hands on what it has.
COUNTED = 1 << 19

# --- counts ----------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of texts, ASCII in lower case, and END; about a megabyte at a time."""
    raw, at = text_bytes(column)
    for first, last in chunks(at):
        yield [[*raw[at[i] : at[i + 1]].tobytes().lower().split(), END] for i in range(first, last)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"]
        )

    found: Counter[bytes] = Counter()
    for batch in batches:
        for texts in _texts(batch["text"]):
            for words in texts:
                found.update(words)
            if len(found) > COUNTED:
                yield handed()
                found.clear()
    if found:
        yield handed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all words and ends of ``docs`` (text), summed in each task first."""
    return docs.select("text").mapInArrow(_count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words with their counts, most frequent first, and totals over all words."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    limit: int = CLASSES

    @property
    def classes(self) -> int:
        """Classes that are single words."""
        return min(self.limit - 1, len(self.words))

    @property
    def rest(self) -> float:
        """Smoothed count of all words outside the classes, one unseen word included."""
        own = float(self.counts[: self.classes].sum())
        return self.total - own + ALPHA * (self.distinct - self.classes + 1)


def vocabulary(counts: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Vocabulary:
    """Collects at most ``head`` words: all that are at least as frequent as a limit from a histogram of counts."""
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    held, least = 0, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        held += row["words"]
        if held > head:
            break
        least = row["bin"]
    some = counts.where(bin_ >= least).collect() if least is not None else []
    some.sort(key=lambda r: (-r["n"], bytes(r["token"])))
    return Vocabulary(
        [bytes(r["token"]) for r in some], np.array([r["n"] for r in some], np.int64),
        sum(r["n"] for r in bins), sum(r["words"] for r in bins), classes,
    )


# --- the model ---------------------------------------------------------------------------


@dataclass
class Parameters:
    """Vectors of context words (the last row: before the text), of classes, biases, weights of two places."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    @staticmethod
    def shapes(classes: int) -> list[tuple[int, ...]]:
        return [(classes + 1, DIM), (classes, DIM), (classes,), (2, DIM)]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.bias, self.place.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray, classes: int) -> Parameters:
        parts, at = [], 0
        for shape in cls.shapes(classes):
            size = math.prod(shape)
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*parts)


def noise_distribution(vocab: Vocabulary) -> np.ndarray:
    """Smoothed share of each class; the last one is that of all other words."""
    counts = np.r_[vocab.counts[: vocab.classes] + ALPHA, vocab.rest]
    return counts / counts.sum()


def initial(noise: np.ndarray) -> Parameters:
    rng = np.random.default_rng(0)
    n = len(noise)
    return Parameters(
        (rng.standard_normal((n + 1, DIM)) * 0.1).astype(np.float32),
        (rng.standard_normal((n, DIM)) * 0.1).astype(np.float32),
        np.log(noise).astype(np.float32),
        np.ones((2, DIM), np.float32),
    )


def _added(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by ``index``."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """One pass of adaptive gradient steps over batches of (first, second context, word)."""

    def __init__(self, noise: np.ndarray):
        self.p = initial(noise)
        self.noise = noise
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cut = np.cumsum(noise)
        self.squares = [np.full_like(x, 1e-2) for x in vars(self.p).values()]
        self.rng = np.random.default_rng(1)

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        p, n = self.p, len(self.noise)
        drawn = np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), n - 1)
        a, b = p.context[far], p.context[near]
        hidden = a * p.place[0] + b * p.place[1]
        own = (hidden * p.target[word]).sum(1) + p.bias[word] - self.log_noise[word]
        other = hidden @ p.target[drawn].T + (p.bias - self.log_noise)[drawn]
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-other, -30, 30)))
        toward = up[:, None] * p.target[word] + down @ p.target[drawn]
        target = _added(word, up[:, None] * hidden, n)
        bias = np.bincount(word, up, n).astype(np.float32)
        np.add.at(target, drawn, down.T @ hidden)
        np.add.at(bias, drawn, down.sum(0))
        context = _added(np.r_[far, near], np.r_[toward * p.place[0], toward * p.place[1]], n + 1)
        place = np.stack([(toward * a).sum(0), (toward * b).sum(0)])
        for value, square, gradient in zip(vars(p).values(), self.squares, (context, target, bias, place)):
            gradient /= len(word)
            square += gradient * gradient
            value += RATE * gradient / np.sqrt(square)


def _classes(ids: np.ndarray, vocab_classes: int) -> np.ndarray:
    """Class of each rank among the frequent words; -1 is a word outside them."""
    return np.where((ids >= 0) & (ids < vocab_classes), ids, vocab_classes)


def _ranks(texts: list[list[bytes]], rank: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each word or -1, all texts end to end, and the bounds of the texts."""
    sizes = np.array([len(t) for t in texts])
    get = rank.get
    ids = np.fromiter((get(w, -1) for t in texts for w in t), np.int64, int(sizes.sum()))
    return ids, np.r_[0, np.cumsum(sizes)]


def _contexts(word: np.ndarray, bounds: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The second and the first class before each word; ``before`` stands ahead of a text."""
    near, far = np.full(len(word), before), np.full(len(word), before)
    near[1:], far[2:] = word[:-1], word[:-2]
    first = bounds[:-1]
    near[first] = far[first] = before
    second = first[np.diff(bounds) > 1] + 1
    far[second] = before
    return far, near


def _train(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        rank = {w: i for i, w in enumerate(vocab.words[: vocab.classes])}
        trainer = Trainer(noise_distribution(vocab))
        held: list[np.ndarray] = []
        waiting = seen = 0
        rng = np.random.default_rng(2)
        for batch in batches:
            for texts in _texts(batch["text"]):
                ids, bounds = _ranks(texts, rank)
                word = _classes(ids, vocab.classes)
                far, near = _contexts(word, bounds, len(trainer.noise))
                order = rng.permutation(len(word))
                held.append(np.stack([far, near, word])[:, order])
                waiting += len(word)
                seen += len(word)
                if waiting < BATCH:
                    continue
                rows = np.concatenate(held, axis=1)
                whole = waiting - waiting % BATCH
                for i in range(0, whole, BATCH):
                    trainer.step(*rows[:, i : i + BATCH])
                held, waiting = [rows[:, whole:]], waiting - whole
        if waiting:
            trainer.step(*np.concatenate(held, axis=1))
        if seen:
            flat = trainer.p.flat().astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))],
                names=["at", "value", "weight"],
            )

    return work


def train(docs: DataFrame, vocab: Vocabulary) -> Parameters:
    """Each task makes one pass over its texts from the same start; the model is their mean by words seen.

    What reaches the driver is one number per parameter.
    """
    noise = noise_distribution(vocab)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    each = docs.select("text").mapInArrow(_train(shared), "at int, value double, weight double")
    mean = each.groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
    flat = initial(noise).flat().astype(float)
    flat[mean["at"].to_numpy(int)] = mean["value"].to_numpy(float)
    return Parameters.of(flat, len(noise))


class Scorer:
    """Normalised log10 probabilities; remembers the sum over classes of each pair of context classes."""

    def __init__(self, p: Parameters):
        self.p = p
        self.n = len(p.bias) + 1
        self.sums = np.full(self.n * self.n, np.nan, np.float32)

    def log10(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = self.p
        pair = far * self.n + near
        missing = np.unique(pair[np.isnan(self.sums[pair])])
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            logits = self._hidden(part // self.n, part % self.n) @ p.target.T + p.bias
            top = logits.max(1, keepdims=True)
            self.sums[part] = np.log(np.exp(logits - top).sum(1)) + top[:, 0]
        own = (self._hidden(far, near) * p.target[word]).sum(1) + p.bias[word]
        return (own - self.sums[pair]).astype(float) / math.log(10)

    def _hidden(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.p.context[far] * self.p.place[0] + self.p.context[near] * self.p.place[1]


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, params = shared.value
        rank = {w: i for i, w in enumerate(vocab.words)}
        log_count = np.r_[np.log10(vocab.counts + ALPHA), 0.0]  # -1: what the join adds
        scorer = Scorer(params)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            tails: list[list] = []
            for texts in _texts(batch["text"]):
                ids, bounds = _ranks(texts, rank)
                word = _classes(ids, vocab.classes)
                far, near = _contexts(word, bounds, len(params.bias))
                model = scorer.log10(far, near, word)
                base = log_count[ids]
                starts = bounds[:-1]
                out[0].append(np.diff(bounds))
                out[1].append(np.add.reduceat((ids >= 0).astype(np.int64), starts))
                out[2].append(np.add.reduceat(base, starts))
                # words outside the classes also need their share of the last class
                out[3].append(np.add.reduceat(model + np.where(word == vocab.classes, base, 0.0), starts))
                out[4].append(np.add.reduceat((word == vocab.classes).astype(np.int64), starts))
                for i, t in enumerate(texts):
                    unknown = np.flatnonzero(ids[bounds[i] : bounds[i + 1]] < 0)
                    tails.append(list(Counter(t[k] for k in unknown).items()))
            arrays = [pa.array(np.concatenate(x)) if x else pa.array([], k) for x, k in zip(
                out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
            items = pa.struct([("token", pa.binary()), ("times", pa.int64())])
            tail = pa.array([[{"token": w, "times": n} for w, n in t] for t in tails], pa.list_(items))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row"], batch["held_out"], *arrays, tail],
                names=["doc_id", "row", "held_out", "n_tokens", "head_known", "head_base", "head_score", "n_rest", "tail"],
            )

    return work


def score(docs: DataFrame, held_out: Column, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``docs`` has doc_id and text; ``held_out`` is a condition on them, and the model
    learns from the rows where it is false, not from those where it is unknown, which
    count as not held out. A null text is empty: one token, the end. Without any
    training text every word scores 0. Scores are sums of log10 probabilities over the
    words and the end. Repeated rows get equal results.
    """
    training = docs.where(~held_out)
    counts = materialize(word_counts(training), "word_counts")
    vocab = vocabulary(counts, head, classes)
    params = train(training, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, params))
    rows = docs.select(
        "doc_id", row_key().alias("row"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"
    )
    kind = dict(docs.dtypes)["doc_id"]
    scored = materialize(
        rows.mapInArrow(
            _score(shared),
            f"doc_id {kind}, row bigint, held_out boolean, n_tokens bigint, head_known bigint, head_base double,"
            " head_score double, n_rest bigint, tail array<struct<token:binary,times:bigint>>",
        ),
        "head_scores",
    )
    tails = scored.select("row", F.inline("tail"))
    known = tails.join(counts, "token", "left").groupBy("row").agg(
        F.sum("times").alias("met"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("tail_base"),
    )
    own = F.aggregate("tail", F.lit(0).cast("bigint"), lambda a, t: a + t["times"])
    found = scored.withColumn("n_tail", own).drop("tail").join(known, "row", "left")
    # rows that are repeated met their words as often as there are such rows
    copies = F.coalesce(F.col("met") / F.col("n_tail"), F.lit(1.0))
    tail = F.coalesce("tail_base", F.lit(0.0)) / copies
    scale = math.log10(vocab.total + ALPHA * (vocab.distinct + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) / copies).cast("bigint").alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + tail - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("head_score") + tail - F.col("n_rest") * F.lit(math.log10(vocab.rest))).alias("score"),
    )
