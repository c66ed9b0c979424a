"""Findings of the third round: growth of memory, driver traffic and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.operators import estep as E
from multitopic.plans.model import TopicModel
from multitopic.sources import corpus as C


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(d, t, f"w{w}", float(c)) for d in range(30) for t in (0, 1) for w, c in zip(rng.choice(60, 12 + d, replace=False), rng.integers(1, 9, 12 + d))]
    return C.Corpus.build(spark.createDataFrame(rows, "doc_id LONG, type_id INT, term STRING, cnt DOUBLE"))


@pytest.mark.parametrize("strategy", ["broadcast", "join"])
def test_hot_rounds_send_nothing_through_the_driver(spark, corpus, strategy, monkeypatch):
    """every round broadcast the documents' weights from the driver."""
    m = TopicModel.create(corpus, k=3, init="assign", strategy=strategy, iterations=6)
    want = {r.doc_id: r for r in m.gamma(corpus.entries).collect()}
    hot = m.with_params(max_doc_terms=7)
    prep = hot.prepare(corpus.entries)
    hot.eb_broadcast()
    seen = []
    inner = E.hot_estep

    def watched(*args, **kw):
        monkeypatch.setattr(E.F, "broadcast", lambda df: seen.append(df) or df)
        return inner(*args, **kw)

    monkeypatch.setattr(E, "hot_estep", watched)
    got = {r.doc_id: r for r in hot.rows(prep, "gamma").collect()}
    assert not seen
    assert prep.hot.count() == len(got) == len(want) == 30
    for d, r in got.items():
        assert np.allclose(r.vec, want[d].gamma, rtol=1e-9) and r.iters == want[d].iters and r.converged == want[d].converged


def test_packed_parts_are_bounded():
    for k, vectors in ((5, 0), (100, 2), (2000, 2)):
        assert 1 <= E.part_limit(10**9, k, vectors) * (16 + 8 * k * vectors) <= max(E.PART_BYTES, 16 + 8 * k * vectors)
    assert E.part_limit(40, 5, 0) == 40


def test_line_items_meet_their_orders_in_bounded_parts(spark, monkeypatch):
    """The tasks of the join grew with the table."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, C.purchases(spark, sf).collect()))
    n = C.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(C, "JOIN_ROWS", n // 20)
    cut = C.purchases(spark, sf)
    assert sorted(map(tuple, cut.collect())) == want
    assert "REPARTITION_BY_NUM" in cut._jdf.queryExecution().executedPlan().toString()


def test_nested_partitions_grow_with_the_entries(spark, corpus, monkeypatch):
    """a fixed number of partitions held ever more documents each."""
    monkeypatch.setattr(E, "NEST_ENTRIES", 100)
    m = TopicModel.create(corpus, k=3, init="assign")
    total = corpus.entries.count()
    assert m.prepare(corpus.entries, reuse=False).nested.rdd.getNumPartitions() == -(-total // 100)


def test_a_scored_update_is_one_kernel_pass(spark, corpus, monkeypatch):
    """every window ran the kernel for the bound and again for the update."""
    from multitopic.plans.train import update

    def train(**kw):
        m = TopicModel.create(corpus, k=3, init="assign", iterations=8, eval_every=1, track_topic_diff=True, alpha="auto", **kw)
        passes = []
        inner = m.rows
        monkeypatch.setattr(m, "rows", lambda *a, **k: passes.append(a[1]) or inner(*a, **k))
        update(m, corpus.entries, chunksize=10, passes=1, update_every=1)
        return m, passes

    m, passes = train()
    other, twice = train(strategy="join")
    assert passes == ["train"] * 3 and len(twice) == 6
    assert [(x["pass"], x["update_no"], x["metric"]) for x in m.metrics] == [(x["pass"], x["update_no"], x["metric"]) for x in other.metrics]
    assert np.allclose([x["value"] for x in m.metrics], [x["value"] for x in other.metrics], rtol=1e-9)
