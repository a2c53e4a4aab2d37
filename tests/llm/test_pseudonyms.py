import datetime
import re

import pytest

from addonscope.llm import pseudonyms as P

KEY = "k"


def moved(spark, texts, key=KEY):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, pii2 STRING")
    return [(r.text, r.pii) for r in P.pseudonymize(docs, key).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def test_formats_and_checks_hold(spark):
    texts = [
        "a 4111 1111 1111 1111 b", "4111111111111111.", "3782-822463-10005", "GB82WEST12345698765432",
        "SSN 123-45-6789", "97.51.17.173", "born 2024-02-29, 31/12/1999, 12/31/1999, 01.02.1950",
        "+1 (017) 555-7713", "Und.34@mail7.example.com",
    ]
    got = moved(spark, texts)
    for (new, kinds), old in zip(got, texts):
        assert kinds and new != old and len(new) == len(old)
        shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
        assert shape(new) == shape(old)
    assert luhn(re.sub(r"\D", "", got[0][0])) and re.sub(r"\D", "", got[0][0]) == re.sub(r"\D", "", got[1][0])
    assert luhn(re.sub(r"\D", "", got[2][0]))
    assert mod97(got[3][0]) == 1
    area, group, serial = map(int, got[4][0][4:].split("-"))
    assert 1 <= area <= 899 and area != 666 and group and serial
    assert all(int(o) < 256 for o in got[5][0].split("."))
    iso = datetime.date.fromisoformat(got[6][0][5:15])
    assert iso.year // 100 == 20


@pytest.mark.parametrize(
    "text", [
        None, "", "plain", "4111111111111112", "666-45-6789", "000-12-3456", "2024-02-30", "1.2.3", "version 1.2.3.4.5",
        "GB00WEST12345698765432", "x4111111111111111", "12345",
    ],
)
def test_what_fails_its_check_stays(spark, text):
    assert moved(spark, [text]) == [(text, [])]


def test_equal_values_stay_linked_and_keys_matter(spark):
    a, b, c = moved(spark, ["4111111111111111 x", "y 4111111111111111", "2001-02-03 2001-02-04"])
    assert a[0].split()[0] == b[0].split()[1]
    assert len(set(c[0].split())) == 2
    assert moved(spark, ["4111111111111111"], "other")[0][0] != a[0].split()[0]


def test_permutation_of_small_domains(spark):
    """Every two-digit string and every day of a month has a pseudonym of its own."""
    from pyspark.sql import functions as F

    digits = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    new = [r.n for r in digits.select(P.permuted_digits(F.col("d"), KEY, "t").alias("n")).collect()]
    assert sorted(new) == [f"{i:02d}" for i in range(100)]
    days = [f"2001-03-{d:02d}" for d in range(1, 32)]
    assert len({t for t, _ in moved(spark, days)}) == 31


def test_same_as_a_plain_feistel(spark):
    import hashlib

    from pyspark.sql import functions as F

    def feistel(digits):
        n = len(digits)
        left, right = digits[: n // 2], digits[n // 2 :]
        sizes = [len(left), len(right)]
        left, right = int(left), int(right)
        for i in range(P.ROUNDS):
            nl, nr = 10 ** sizes[0], 10 ** sizes[1]
            h = hashlib.sha256(f"{KEY}|t|{i}|{nl}|{nr}|{right}".encode()).hexdigest()
            left, right = right, (left + int(h[:15], 16)) % nl
            sizes.reverse()
        return f"{left:0{sizes[0]}d}{right:0{sizes[1]}d}"

    texts = ["12", "987654321", "000000000000001", "4111111111111111"]
    rows = spark.createDataFrame([(t,) for t in texts], "d STRING")
    got = [r.n for r in rows.select(P.permuted_digits(F.col("d"), KEY, "t").alias("n")).collect()]
    assert got == [feistel(t) for t in texts]


def test_empty_table_and_clashing_column(spark, no_docs):
    assert P.pseudonymize(no_docs, KEY).count() == 0
    docs = spark.createDataFrame([("10.0.0.1", "mine")], "text STRING, pii STRING")
    row = P.pseudonymize(docs, KEY, found="pii_").first()
    assert row.pii == "mine" and row.pii_ == ["ip"]
