import pytest

from addonscope.llm import mixing as M


def targets(sizes):
    """Shares by weight, those beyond their limit cut and the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        rest = [s for s in order if s not in fixed]
        share = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_by_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, None: 50}, {"x": 0, "y": 5}, {"é": 7, "z": 9, "A": 4, "": 1}):
        rows = spark.createDataFrame(list(sizes.items()), "source STRING, source_size BIGINT")
        got = {r.source: r.target for r in M.targets(rows).collect()}
        assert got == pytest.approx(targets(sizes))


def test_sources_come_to_their_targets(docs, rows):
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.5
    assert sorted(map(tuple, M.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixture_is_in_global_order(docs):
    mixed = M.mixture(docs.withColumnRenamed("lang", "size"))
    assert mixed.columns == ["doc_id", "text", "source", "n_chars", "size", "target", "taken", "virtual_finish"]
    finish = [r.virtual_finish for r in mixed.collect()]
    assert finish == sorted(finish) and finish


def test_empty_tables(spark, no_docs):
    assert M.mix(no_docs).count() == 0 and M.mixture(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id BIGINT, text STRING, source STRING")
    assert [(r.size, r.taken, r.target) for r in M.mix(blank).collect()] == [(0, 0, 0.0)] * 2
