"""Token counts of a byte-level BPE tokenizer by a whole-token shortcut.

A pre-token that the vocabulary encodes alone as one token counts as one without running
the merges. Which strings these are is proved once, by encoding every string of the
vocabulary with the library. Only the other pre-tokens are merged, by the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from addonscope.llm.common import chunks, text_bytes

#: The pre-token pattern of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens a worker remembers, and the longest of them in characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 17, 64
#: Characters outside blocks on whose classes the pattern library and the tokenizer agree (they know
#: different versions of Unicode). A text that holds one is counted by the tokenizer alone.
UNSURE = "[^\u0000-\u052f\u0590-\u088e\u0900-\u0c5b\u0d00-\u208e\u20a0-\ua7cd\uab70-\uffff\U0001f300-\U0001faff]"


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Strings of the vocabulary that the tokenizer encodes alone as one token."""
    special = set(tokenizer.get_added_tokens_decoder())
    ids = [i for i in range(tokenizer.get_vocab_size()) if i not in special]
    strings = [tokenizer.decode([i]) for i in ids]
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found) if len(e.ids) == 1)


def supported(definition: str) -> None:
    """Raises where the shortcut would not hold for a tokenizer definition (JSON)."""
    parts = json.loads(definition)
    pre = parts["pre_tokenizer"] or {}
    plain = (
        parts["model"]["type"] == "BPE"
        and not parts["normalizer"]
        and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])
    )
    if not plain:
        raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")


class Counter:
    """Counts tokens of texts with the tokenizer of ``definition``."""

    def __init__(self, definition: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        longest_first = sorted(added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.pieces = regex.compile(PRE_TOKENS).findall
        self.unsure = regex.compile(UNSURE).search
        self.known = dict.fromkeys(whole, 1)
        self.room = len(self.known) + REMEMBERED
        self.whole = whole

    def library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, pieces: list[str]) -> dict[str, int]:
        distinct = list(set(pieces))
        found = dict(zip(distinct, self.library(distinct)))
        if len(self.known) + len(found) > self.room:
            self.known = dict.fromkeys(self.whole, 1)
        self.known.update((p, n) for p, n in found.items() if len(p) <= REMEMBERED_CHARS)
        return found

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        rest: list[str] = []
        owners: list[int] = []
        get = self.known.get
        for i, text in enumerate(texts):
            if not text.isascii() and self.unsure(text):
                out[i] = self.library([text])[0]
                continue
            parts = self.added.split(text) if self.added else [text]
            total = len(parts) - 1
            for part in parts:
                pieces = self.pieces(part)
                counts = [get(p) for p in pieces]
                if None in counts:
                    missing = [p for p, n in zip(pieces, counts) if n is None]
                    rest += missing
                    owners += [i] * len(missing)
                    total += sum(n for n in counts if n is not None)
                else:
                    total += sum(counts)
            out[i] = total
        if rest:
            found = self._merge(rest)
            for i, p in zip(owners, rest):
                out[i] += found[p]
        return out


def _count(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            raw, at = text_bytes(batch["text"])
            counts: list[int] = []
            for first, last in chunks(at):
                texts = [raw[at[i] : at[i + 1]].tobytes().decode() for i in range(first, last)]
                counts += counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(at)), pa.array(np.array(counts, np.int64))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return work


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text).

    ``path`` is a tokenizer definition for the tokenizers library, read on the driver;
    what goes to the executors is its text and the proved strings, a few MB that depend
    on the vocabulary alone. Counts are the library's without special tokens added and
    with special strings in a text taken as such. Null texts count as empty: no bytes,
    no tokens. Repeated rows are kept.
    """
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    supported(definition)
    whole = whole_tokens(Tokenizer.from_str(definition))
    shared = docs.sparkSession.sparkContext.broadcast((definition, whole))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _count(shared), f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )


def limited(counts: DataFrame, most: int = 512) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > most)
