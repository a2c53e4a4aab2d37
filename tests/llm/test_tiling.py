import random

from addonscope.llm import tiling
from addonscope.llm.queries import op3_decontamination


def brute(a, b, least=tiling.WORDS):
    """Greedy tiling word by word."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (
                    i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                    and i + n not in used_a and j + n not in used_b
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        used_a.update(range(best[0], best[0] + best[2]))
        used_b.update(range(best[1], best[1] + best[2]))


def test_tiles_cover_what_brute_force_covers():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(30)]
        b = a[10:20] + a[:9] + [rng.choice("abc") for _ in range(5)]
        seeds = [
            (i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]
        ]
        got = tiling.tiles(*np.array(seeds).T) if seeds else []
        want = brute(a, b)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)


def test_reordered_passages_are_found(spark, docs, no_docs, rows):
    passage = " ".join(f"w{i}" for i in range(40)).split()
    moved = " ".join(passage[20:] + ["x"] * 3 + passage[:20]).upper()
    half = " ".join(passage[:20])
    mine = [
        (1, "Start. " + moved + " end"), (2, half), (3, None), (4, ""), (5, "; ".join(passage)), (5, "; ".join(passage)),
        (6, "y " * 3000), (None, " ".join(passage)),
    ]
    bench = [(7, " ".join(passage)), (7, " ".join(passage)), (8, None), (9, "too short"), (None, "q r s t u v w")]
    documents = spark.createDataFrame(mine, "doc_id BIGINT, text STRING")
    items = spark.createDataFrame(bench, "item_id BIGINT, text STRING")
    from addonscope.llm.common import row_key

    got = tiling.contamination(documents, items).collect()
    keys = {r.row: r.doc_id for r in documents.select("doc_id", row_key().alias("row")).collect()}
    assert sorted((keys[r.row] or 0, r.item_id, r.n_tiles, r.coverage) for r in got) == [
        (0, 7, 1, 1.0), (1, 7, 2, 1.0), (5, 7, 1, 1.0),
    ]
    assert tiling.contamination(documents, items.limit(0)).count() == 0
    assert tiling.contamination(documents.limit(0), items).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    import re

    def words(text):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))

    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = words(r.text)
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item, w in items:
            covered = set()
            for j in range(len(w) - 4):
                if tuple(w[j : j + 5]) in grams:
                    covered.update(range(j, j + 5))
            if len(covered) >= tiling.COVERAGE * len(w):
                want.add(r.doc_id)
    got = {r.doc_id for r in op3_decontamination(spark, sf).where("contaminated").collect()}
    assert got == want and want
