import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from addonscope.llm import tokencount as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter(tokenizer):
    with open(PATH, encoding="utf-8") as f:
        return T.Counter(f.read(), T.whole_tokens(tokenizer))


def library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_one_token(tokenizer):
    whole = T.whole_tokens(tokenizer)
    assert " the" in whole and len(whole) > 40_000
    assert set(library(tokenizer, sorted(whole)[:2000])) == {1}


def test_texts_as_the_library_counts_them(tokenizer, counter, rows):
    texts = [t or "" for _, t, *_ in rows] + [
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's  we'll\n\n x\t", "x" * 3000, "日本語 テキスト 한국어",
        "🙂🙃 emoji", "\x1c\x85   a", "1234567 ½ Ⅷ", "naïve ÀÉ", " ",
    ]
    assert counter.count(texts) == library(tokenizer, texts)


def test_every_character(tokenizer, counter):
    """Blocks on which the pattern library and the tokenizer disagree go to the tokenizer."""
    rng = random.Random(0)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c}{c} ." for c in rng.sample(chars, 30_000) + chars[:0x3000]]
    assert counter.count(texts) == library(tokenizer, texts)


def test_table(spark, docs, no_docs, rows, tokenizer):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in T.limited(
        T.token_counts(docs.withColumnRenamed("lang", "n_tokens"), PATH)).collect())
    counts = library(tokenizer, [t or "" for _, t, *_ in rows])
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts))
    assert T.token_counts(no_docs, PATH).count() == 0


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        T.supported(f.read())
