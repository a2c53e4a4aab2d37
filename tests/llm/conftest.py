import random

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
SYLLABLES = {
    "en": ["the", "of", "and", "th", "er", "on", "ing", "tion", "wh", "ou"],
    "de": ["der", "die", "und", "sch", "ung", "keit", "ver", "ä", "ß", "ge"],
    "fr": ["le", "la", "et", "eau", "eux", "é", "que", "ment", "oi", "ç"],
}


def words(rng, lang, n):
    return [
        "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)
    ]


@pytest.fixture(scope="session")
def rows():
    """Documents of three languages with copies, near copies, shared passages and odd cases."""
    rng = random.Random(5)
    out = []
    passage = " ".join(words(rng, "en", 40))
    for i in range(60):
        lang = ["en", "en", "de", "fr"][i % 4]
        text = " ".join(words(rng, lang, rng.randint(20, 220)))
        if i % 7 == 0:
            text = text[:60] + " " + passage + " " + text[60:]
        out.append((i, text, lang, f"s{i % 5}", len(text)))
    base = out[8][1].split()
    for i in range(60, 70):
        near = list(base)
        near[rng.randrange(len(near))] = f"word{i}"
        out.append((i, " ".join(near if i % 2 else base), "en", "s0", 0))
    out += [
        (70, None, "en", "s1", None), (71, "", "de", "s2", 0), (72, " \n\t ", None, None, 3),
        (73, "123 456 !!", "en", "s1", 10), (74, "a", "en", None, 1), (75, "ab " * 400, "en", "s3", 1200),
        (76, "x" * 5000, None, "s3", 5000), (77, " ".join(words(rng, "de", 8000)), "de", "s4", 0),
        (8, out[8][1], "en", "s3", 0), (8, out[8][1], "en", "s3", 0), (9, "another text under one id " * 5, "en", "s1", 0),
        (None, out[20][1], "en", "s0", 0), (None, "no id here " * 9, None, None, 0),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
