import hashlib
import re

from pyspark.sql import functions as F

from addonscope.llm import secret_scan as S

TEXTS = [
    None, "", "nothing here", "password = short", "Password: 'longenough1' and TOKEN=abcdefgh",
    "é token==abc.def-gh_i=/+ x", "AKIA" + "A1" * 6 + " AKIA123 " + "0af3" * 9, "api key=abcdefgh apikey=abcdefgh",
    "passwd=password=secretvalue", "ghp_" + "aB3" * 12 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890",
    "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK https://user.name:s3cretpw@host", "SECRET" * 3, "token = 12345678" * 300,
]


def spans(text):
    out = []
    for kind, rule in enumerate(S.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_spans_are_those_of_the_patterns(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 0, "x"), (None, TEXTS[5], 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, rules INT, spans STRING")
    got = S.scan(docs.select("doc_id", "text", "rules", "spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[5] if r.doc_id is None else TEXTS[r.doc_id]
        assert [tuple(s) for s in r.spans] == spans(text or "")


def test_base_runs_equal_the_unbounded_ones():
    """Bounds inside the patterns find what dropping short matches finds."""
    for pattern, least, bounded in ((r"AKIA[A-Z0-9]+", 16, S.BASE[1]), (r"[0-9a-f]+", 32, S.BASE[2])):
        for text in TEXTS + ["AKIAAKIA" + "Z" * 9 + "AKIA" * 5, "f" * 31 + " " + "e" * 32 + "g"]:
            want = [m.span() for m in re.finditer(pattern, text or "") if len(m.group()) >= least]
            assert [m.span() for m in re.finditer(bounded.pattern, text or "")] == want


def test_trigram_queries_are_necessary():
    assert not all(S.trigram_query(r"[0-9a-f]{32,}"))
    assert S.trigram_query("abcd|xyz") == frozenset([frozenset(["abc", "bcd"]), frozenset(["xyz"])])
    for rule in S.RULES:
        clauses = S.trigram_query(rule.pattern)
        for text in TEXTS:
            for m in re.finditer(rule.pattern, text or ""):
                assert any(all(g in m.group().lower() for g in c) for c in clauses)


def test_running_sums(spark):
    for n in (0, 1, 2, 7, 50):
        row = spark.range(1).select(
            F.expr(S.running(f"transform(slice(sequence(0, 60), 1, {n}), x -> cast(x as bigint))")).alias("r")
        ).first()
        assert row.r == [sum(range(i)) for i in range(n)]


def test_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_digest_of_no_span(spark):
    from addonscope.llm.queries import op1_secret_scan

    found = op1_secret_scan(spark, "/root/testdata/sf0.001").where("spans = ''").first()
    assert found is None or found.base_sha256 == hashlib.sha256(b"").hexdigest()
