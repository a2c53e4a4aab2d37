import numpy as np
import xxhash

from addonscope.llm import anchors as A
from addonscope.llm.components import connected_components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_code_covers_with_its_radius():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 1 << 32, 4000)
    index, anchor, home = A.guests(half.astype(np.int64), 0, 2)
    assert (np.bincount(index[home], minlength=4000) == 1).all()
    words = anchor ^ half[index]
    own = words[home]
    assert (np.bitwise_count(own & 0x7FFFFF) <= 3).all() and (np.bitwise_count(own >> 23 & 0x7F) <= 1).all()
    assert (own >> 30 == 0).all()
    assert (A.half_syndromes(anchor & 0xFFFFFFFF) == 0).all()


def test_near_words_meet_at_a_home():
    """Whoever differs in up to 4 bits is a guest at the other's home in some half."""
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 63), 1 << 63, 3000)
    y = x.copy()
    for _ in range(4):
        y ^= np.left_shift(np.int64(1), rng.integers(0, 64, 3000))
    met = np.zeros(3000, bool)
    for shift, threshold in A.HALVES:
        index, anchor, home = A.guests(x, shift, threshold)
        own = np.zeros(3000, np.int64)
        own[index[home]] = anchor[home]
        index, anchor, _ = A.guests(y, shift, threshold)
        met[index[anchor == own[index]]] = True
    assert met.all()


def check(got, rows):
    fps = [fingerprint(t) for _, t in rows]
    near = [[j for j, g in enumerate(fps) if (f ^ g).bit_count() <= 4] for f in fps]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    ids = [min((r[0] for r, m in zip(rows, label) if m == l and r[0] is not None), default=None) for l in label]
    want = sorted((str(r[0]), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, ids))
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in got) == want


def test_components_against_all_pairs(docs, rows, monkeypatch):
    monkeypatch.setattr(A, "ANCHOR_ROWS", 2)
    check(A.near_duplicates(docs.withColumnRenamed("lang", "fp")).collect(), [(r[0], r[1]) for r in rows])


def test_one_document_stays(docs, rows):
    first = A.representatives(A.near_duplicates(docs))
    assert first.count() == first.distinct().count() == A.near_duplicates(docs).select("root").distinct().count()


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(A.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_crowded_links_stay_few(spark):
    """A group of n fingerprints that are all near gives about n rows per anchor, not n * n."""
    near = [(int(a) ^ int(b),) for a in (1 << np.arange(30)) for b in (1 << np.arange(30)) if a < b]
    rows = spark.createDataFrame(near, "fp BIGINT")
    found = A.links(rows)
    assert connected_components(found).select("component").distinct().count() == 1


def test_empty_table(no_docs):
    assert A.near_duplicates(no_docs).count() == 0


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
