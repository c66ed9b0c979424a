"""Findings of the fourth round: many updates of a small state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.operators import estep as E
from multitopic.plans.evaluate import beta_part
from multitopic.plans.model import TopicModel
from multitopic.plans.train import update
from multitopic.sources import corpus as C


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    rows = [(d, t, f"w{w}", float(c)) for d in range(60) for t in (0, 1) for w, c in zip(rng.choice(40, 5 + d % 9, replace=False), rng.integers(1, 9, 5 + d % 9))]
    return C.Corpus.build(spark.createDataFrame(rows, "doc_id LONG, type_id INT, term STRING, cnt DOUBLE"))


def trained(corpus, docs=None, chunksize=10, **kw):
    run = {x: kw.pop(x) for x in ("passes", "update_every", "callbacks") if x in kw}
    m = TopicModel.create(corpus, k=3, iterations=8, seed=5, track_topic_diff=True, **kw)
    return update(m, corpus.entries, docs, chunksize=chunksize, **{"update_every": 1} | run)


def state_of(m):
    return {(r.type_id, r.term_id): (*r.s, r.eta0, r.eta) for r in m.state.collect()}


def test_an_update_of_a_small_state_is_one_job(spark, corpus):
    """every update ran several jobs, each over the whole corpus."""
    jobs = []
    for size in (10, 4):  # 6 and 15 updates a pass
        spark.sparkContext.setJobGroup(f"updates-{size}", "")
        trained(corpus, chunksize=size, passes=2, init="random", eval_every=1, alpha="auto")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"updates-{size}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 2 * (15 - 6)


@pytest.mark.parametrize(
    "few, kw",
    [
        (True, {"init": "random", "eval_every": 1, "passes": 2, "chunksize": 20}),
        (False, {"init": "assign", "eval_every": 2, "update_every": 2, "alpha": "auto"}),
        (True, {"init": "assign", "eval_every": 0, "eta": {0: 0.2, 1: 0.7}, "gamma_start": "random", "update_every": 3}),
    ],
)
def test_dealt_windows_equal_the_join_strategy(spark, corpus, monkeypatch, few, kw):
    docs = spark.createDataFrame([(d,) for d in (-5, *range(60), 7000)], "doc_id LONG")  # two without entries
    if few:  # several partitions per window, a partition of blocks for each of them, blocks of few documents
        for name, value in (("SLICE_LEAST", 20), ("RUN_ENTRIES", 1), ("BLOCK_ENTRIES", 30)):
            monkeypatch.setattr(E, name, value)
    dealt = []
    inner = E.deal
    monkeypatch.setattr(E, "deal", lambda *a: dealt.append(inner(*a)) or dealt[-1])
    m = trained(corpus, docs, **kw)
    other = trained(corpus, docs, strategy="join", **kw)
    assert len(dealt) == 1 and (dealt[0].slices > 1) == few and (dealt[0].run == 1) == few
    assert [(x["pass"], x["update_no"], x["metric"]) for x in m.metrics] == [(x["pass"], x["update_no"], x["metric"]) for x in other.metrics]
    assert np.allclose([x["value"] for x in m.metrics], [x["value"] for x in other.metrics], rtol=1e-9)
    a, b = state_of(m), state_of(other)
    assert a.keys() == b.keys() and all(np.allclose(a[t], b[t], rtol=1e-9) for t in a)
    assert np.allclose(m.alpha, other.alpha, rtol=1e-9) and (m.version, m.num_updates) == (other.version, other.num_updates)
    assert m.held is None and not dealt[0].blocks.is_cached


def test_a_window_is_read_from_its_own_partitions(spark, corpus, monkeypatch):
    for name, value in (("SLICE_LEAST", 20), ("RUN_ENTRIES", 100)):
        monkeypatch.setattr(E, name, value)
    m = TopicModel.create(corpus, k=3, init="assign")
    chunks = C.chunk_assignment(corpus.entries.select("doc_id").distinct(), 5)
    prep = m.prepare(corpus.entries, None, chunks)
    sizes = {r["chunk_id"]: r["n"] for r in prep.entries.groupBy("chunk_id").agg(F.count("*").alias("n")).collect()}
    m.deal(prep, 2, 12, sizes)
    dealt = prep.dealt
    inside = [{r.chunk_id for r in part} for part in dealt.blocks.glom().collect()]
    for lo in range(0, 12, 2):
        at = dealt.partitions(lo)
        assert len(at) == dealt.slices < len(inside)
        assert all(i in at for i, c in enumerate(inside) if c & {lo, lo + 1})
    m.release()
    prep.drop()


def test_slices_are_bounded():
    assert E.slice_count(100, 8) == 1 and E.slice_count(10 * E.SLICE_LEAST, 8) == 8
    assert E.slice_count(3 * E.SLICE_LEAST, 1000) == 3 and E.slice_count(100 * E.SLICE_MOST, 8) == 100


def test_a_failed_pass_keeps_the_finished_updates(spark, corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=8)
    seen = []

    def cb(model, pass_):
        seen.append((state_of(model), beta_part(model)))  # the state is written before callbacks see it
        if pass_ == 1:
            raise RuntimeError("stop")
        return {}

    with pytest.raises(RuntimeError, match="stop"):
        update(m, corpus.entries, chunksize=10, update_every=1, passes=3, eval_every=0, callbacks=[cb])
    assert len(seen) == 2 and seen[0][0] != seen[1][0] and state_of(m) == seen[1][0]
    model = TopicModel.create(corpus, k=3, init="assign", iterations=8)
    update(model, corpus.entries, chunksize=10, update_every=1, passes=2, eval_every=0)
    assert all(np.allclose(v, seen[1][0][t], rtol=1e-9) for t, v in state_of(model).items())
    model.hold()
    assert beta_part(model) == pytest.approx(seen[1][1], rel=1e-9)
    model.release()


def test_no_documents_change_nothing(spark, corpus):
    """documents are counted from the written chunks; without any nothing is left."""
    import os

    from multitopic.session import scratch_path

    folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    m = TopicModel.create(corpus, k=3, init="assign")
    before = set(os.listdir(folder))
    with pytest.warns(UserWarning, match="no documents"):
        update(m, corpus.entries.where("doc_id < 0"), chunksize=10)
    assert set(os.listdir(folder)) == before and m.version == 0 and not m.metrics
