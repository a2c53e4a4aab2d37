import corpus_pipeline as C
import pytest
from addonscope.llm import anchors, langid, tiling
from addonscope.llm.queries import training


@pytest.fixture
def folder(spark, tmp_path):
    items = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten")], "item_id BIGINT, text STRING"
    )
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, docs, rows, folder):
    leak = [(900, "Six seven eight nine ten, one TWO three four five and so the on", "en", "s0", 1)]
    pii = [(901, "the ing of tion " + "and er wh ou " * 9 + "call +1 (017) 555-7713", "en", "s0", 1)]
    docs = docs.unionByName(spark.createDataFrame(leak + pii, docs.schema))
    model = langid.fit(training(docs))
    found = docs
    columns = docs.columns
    seen = {}
    for name, stage in C.STAGES:
        found = stage(spark, found, folder).cache()
        seen[name] = [r.asDict() for r in found.collect()]
        if name != "mixing":
            assert found.columns == columns
    kept = {r["doc_id"] for r in seen["language_id"]}
    assert not kept & {70, 71, 72, 73} and {i for i in range(60)} <= kept
    unique = [r["doc_id"] for r in seen["simhash_near_dedup"]]
    assert unique.count(8) == 1 and len(unique) < len(seen["language_id"])
    assert 900 in unique and 900 not in {r["doc_id"] for r in seen["benchmark_decontamination"]}
    assert len(seen["benchmark_decontamination"]) == len(unique) - 1
    assert "555-7713" not in next(r["text"] for r in seen["pii"] if r["doc_id"] == 901)
    assert all(r["taken"] > 0 for r in seen["mixing"])
    assert model.langs


def test_empty_input(spark, no_docs, folder):
    found = no_docs
    for _, stage in C.STAGES:
        found = stage(spark, found, folder)
    assert found.count() == 0


def test_run_equals_brute_force_on_the_small_tables(spark):
    """Kept documents are those that plain rules keep."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in C.run(spark, sf).collect()}
    marked = {r.doc_id: r.component_id for r in anchors.near_duplicates(docs).collect()}
    leaks = tiling.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select("row")
    from addonscope.llm.common import row_key

    bad = {r.doc_id for r in docs.select("doc_id", row_key().alias("row")).join(leaks, "row").collect()}
    allowed = {i for i, c in marked.items() if i == c} - bad
    assert got <= allowed and len(got) > 0.5 * len(allowed)
