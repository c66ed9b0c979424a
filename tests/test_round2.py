"""Regressions: learning rate, priors, bound, saving, resuming, comparison, browser tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.operators import compare, hyper, vis
from multitopic.operators.topics import term_topics, word_topics
from multitopic.plans.evaluate import bound, log_perplexity
from multitopic.plans.model import TopicModel
from multitopic.plans.train import update
from multitopic.session import materialize, scratch_path
from multitopic.sources import corpus as C
from multitopic.sources import model_io
from multitopic.streaming.online import StreamTrainer

ROWS = [(d, t, f"w{(d * 7 + k) % 9}", float(1 + (d + k) % 3)) for d in range(20) for t in (0, 1) for k in range(4)]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, type_id int, term string, cnt double")


@pytest.fixture(scope="module")
def corpus(spark, terms):
    vocab = materialize(C.vocabulary(terms), "vocab")
    return C.Corpus(materialize(C.encode(terms, vocab), "entries"), vocab, 2)


def test_explicit_chunksize_enters_the_learning_rate(corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    e = corpus.entries
    update(m, e.where("doc_id < 16"), chunksize=100, eval_every=0)
    update(m, e.where("doc_id >= 16"), chunksize=100, eval_every=0)
    rho = [x["value"] for x in m.metrics if x["metric"] == "rho"]
    assert abs(rho[1] - (1 + 16 / 100) ** -0.5) < 1e-12


def test_overrides_end_with_the_call(spark, corpus):
    m = TopicModel.create(corpus, k=3, init="assign")
    with pytest.warns(UserWarning, match="no documents"):
        update(m, corpus.entries.where("false"), iterations=7)
    with pytest.raises(ZeroDivisionError):
        update(m, corpus.entries, iterations=7, eval_every=0, callbacks=[lambda *_: 1 / 0])
    assert m.params.iterations == 50


def test_eta_tables_must_cover_the_vocabulary(corpus):
    eta = corpus.vocab.select("type_id", "term_id", F.lit(0.3).alias("eta"))
    assert TopicModel.create(corpus, k=2, eta=eta, init="assign").state.count() == corpus.vocab.count()
    for bad in (eta.where("term_id > 0"), eta.unionByName(eta), {0: 0.1}):
        with pytest.raises(ValueError):
            TopicModel.create(corpus, k=2, eta=bad, init="assign")


def test_newton_step_solves_the_linear_system():
    from multitopic.functions.special import digamma_np, trigamma_np

    a, n, l, rho = np.array([0.4, 1.3, 0.9]), 50.0, np.array([-2.0, -0.6, -0.9]), 0.1
    g = n * (digamma_np(a.sum()) - digamma_np(a) + l)
    hessian = n * trigamma_np(a.sum()) * np.ones((3, 3)) - n * np.diag(trigamma_np(a))
    got, ok = hyper.newton_step(a, n, l, rho)
    assert ok and np.allclose(got, a - rho * np.linalg.solve(hessian, g))
    assert not hyper.newton_step(a, n, l * 40, 5.0)[1]


def test_bound_uses_lambda_and_stays_finite(spark, corpus):
    m = TopicModel.create(corpus, k=3, init="random", eta=0.001, seed=2)
    g = m.gamma(corpus.entries)
    want = bound(m, corpus.entries, gamma=g)
    assert abs(bound(m, corpus.entries) - want) < 1e-6 * abs(want)
    assert abs(bound(m.with_params(strategy="join"), corpus.entries) - want) < 1e-6 * abs(want)
    assert abs(bound(m.with_params(max_doc_terms=3), corpus.entries) - want) < 1e-6 * abs(want)
    state = m.state.withColumn("s", F.when(F.col("term_id") == 0, F.array_repeat(F.lit(0.0), 3)).otherwise(F.col("s")))
    tiny = TopicModel.create(corpus, k=3, init="given", state=state.withColumn("eta0", F.lit(0.0005)))
    assert np.isfinite(bound(tiny, corpus.entries)) and np.isfinite(log_perplexity(tiny, tiny.prepare(corpus.entries), total_docs=100))
    with pytest.raises(Exception, match="no gamma"):
        bound(m, corpus.entries, gamma=g.where("doc_id > 3"))


def test_model_saved_over_its_own_path(spark, corpus):
    path = scratch_path(spark, "own-path")
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    update(m, corpus.entries, eval_every=0)
    model_io.save(m, path)
    for _ in range(3):
        again = model_io.load(spark, path)
        model_io.save(again, path)
    again = model_io.load(spark, path)
    assert again.metrics == m.metrics and again.numdocs == m.numdocs
    assert {(r.type_id, r.term_id): r.s for r in again.state.collect()} == {(r.type_id, r.term_id): r.s for r in m.state.collect()}
    with pytest.raises(FileNotFoundError):
        model_io.load(spark, scratch_path(spark, "nothing"))


def test_stream_resumes_from_the_committed_model(spark, terms, corpus):
    def fresh():
        return TopicModel.create(corpus, k=3, init="assign", iterations=5)

    parts = [terms.where(f"doc_id % 3 = {k}") for k in range(3)]
    whole = StreamTrainer(fresh(), lambda b: b, scratch_path(spark, "whole"))
    for k, p in enumerate(parts):
        whole(p, k)
    path = scratch_path(spark, "stopped")
    first = StreamTrainer(fresh(), lambda b: b, path)
    first(parts[0], 0)
    second = StreamTrainer(fresh(), lambda b: b, path)
    assert second.committed == 0 and second.model.numdocs == first.model.numdocs
    second(parts[0], 0)
    second(parts[1], 1)
    third = StreamTrainer(fresh(), lambda b: b, path)
    third(parts[2], 2)
    a = {(r.type_id, r.term_id): r.s for r in whole.model.state.collect()}
    b = {(r.type_id, r.term_id): r.s for r in third.model.state.collect()}
    assert max(np.abs(np.array(a[k]) - np.array(b[k])).max() for k in a) < 1e-9 and third.model.numdocs == 20


def test_training_leaves_only_the_state(spark, corpus):
    import os

    folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    update(m, corpus.entries, chunksize=5, eval_every=0)
    before = set(os.listdir(folder))
    update(m, corpus.entries, chunksize=5, eval_every=0)
    new = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert new <= {"state"}


def test_comparison_of_equal_and_foreign_models(spark, terms, corpus):
    m = TopicModel.create(corpus, k=3, init="assign")
    for diagonal in (False, True):
        for normed in (False, True):
            z = compare.diff(m, m, "hellinger", diagonal=diagonal, normed=normed, annotation=False).where("topic1 = topic2").collect()
            assert [r.z for r in z] == [0.0] * 3
    other = C.vocabulary(terms.withColumn("term", F.concat(F.lit("x"), "term")))
    foreign = TopicModel.create(C.Corpus(corpus.entries, other, 2), k=3, init="assign")
    with pytest.raises(ValueError, match="vocabulary"):
        compare.diff(m, foreign)
    b = TopicModel.create(corpus, k=3, init="assign", assign_rule="div")
    for name in ("kullback_leibler", "hellinger", "jensen_shannon"):
        whole = {r.topic1: r.z for r in compare.diff(m, b, name, annotation=False, normed=False).where("topic1 = topic2").collect()}
        cells = {r.topic1: r.z for r in compare.diff(m, b, name, diagonal=True, annotation=False, normed=False).collect()}
        assert whole.keys() == cells.keys() and all(abs(whole[k] - cells[k]) < 1e-9 for k in whole)


def test_browser_tables(spark, terms, corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    out = vis.prepare(m, terms, corpus.entries)
    assert out["topic_proportion"].count() == 3 and out["doc_topic_dists"].count() == 60
    assert abs(out["topic_proportion"].agg(F.sum("proportion")).first()[0] - 1) < 1e-9
    assert out["saliency"].count() == corpus.vocab.count() and out["topic_distance"].count() == 9
    g = m.gamma(corpus.entries)
    same = vis.prepare(m, terms, corpus.entries, supplied=g.select("doc_id", "gamma"))
    a = {(r.doc_id, r.topic): r.theta for r in out["doc_topic_dists"].collect()}
    assert all(abs(a[r.doc_id, r.topic] - r.theta) < 1e-9 for r in same["doc_topic_dists"].collect())
    for bad in (g.select("doc_id", F.slice("gamma", 1, 2).alias("g")), g.where("doc_id > 2").select("doc_id", "gamma"), g.select("doc_id", F.lit(3).alias("topic"), F.lit(1.0).alias("p"))):
        with pytest.raises(ValueError):
            vis.prepare(m, terms, corpus.entries, supplied=bad)
    with pytest.raises(ValueError):
        vis.prepare(m, terms, corpus.entries.withColumn("term_id", F.lit(999)))


def test_word_topics_needs_no_shuffle_above_the_kernel(corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    nodes = lambda df: [df._jdf.queryExecution().executedPlan().toString().count(x) for x in (" Exchange ", " Window ", " Sort ")]
    assert nodes(word_topics(m, corpus.entries)) == nodes(m.estep_rows(corpus.entries, "phi"))


def test_topics_of_given_words(spark, corpus):
    m = TopicModel.create(corpus, k=3, init="assign")
    one = spark.createDataFrame([(0, "w1"), (1, "nowhere")], "type_id int, term string")
    got = term_topics(m, terms=one).select("type_id", "term_id").distinct().collect()
    want = corpus.vocab.where("type_id = 0 AND term = 'w1'").first()
    assert [(r.type_id, r.term_id) for r in got] == [(0, want.term_id)]


def test_callbacks_and_forced_broadcast_limit(corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5)
    update(m, corpus.entries, passes=2, eval_every=0, callbacks=[lambda model, p: {"own": p * 2.0}])
    assert [x["value"] for x in m.metrics if x["metric"] == "own"] == [0.0, 2.0]
    with pytest.raises(ValueError, match="broadcast_limit_bytes"):
        m.with_params(strategy="broadcast", broadcast_limit_bytes=8).gamma(corpus.entries).count()


def test_states_with_document_counts(corpus):
    from multitopic.operators import state as S

    a, b = (TopicModel.create(corpus, k=2, init="assign", assign_rule=r).state for r in ("mod", "div"))
    other = b.select("type_id", "term_id", F.col("s").alias("vec"))
    rows = lambda df: {(r.type_id, r.term_id): np.array(r.s) for r in df.collect()}
    x, y = rows(a), rows(b)
    got, n = S.blend_states(a, 10, other, 5, 0.25, target=40)
    assert n == 40 and all(np.allclose(v, 0.75 * 4 * x[k] + 0.25 * 8 * y[k]) for k, v in rows(got).items())
    got, n = S.blend_states(a, 0, other, 20, 0.5)
    assert n == 0 and all(np.allclose(v, 0.5 * x[k]) for k, v in rows(got).items())
    got, n = S.blend2_states(a, 10, other, 30)
    assert n == 30 and all(np.allclose(v, x[k] + y[k]) for k, v in rows(got).items())
    got, n = S.merge_states(a, 10, b, 5, 2)
    assert n == 15 and all(np.allclose(v, x[k] + y[k]) for k, v in rows(got).items())


def test_scoring_by_index(corpus):
    m = TopicModel.create(corpus, k=3, init="assign", iterations=5, per_word_topics=True, minimum_phi_value=0.2)
    topics, words, values = m[corpus.entries]
    assert sorted(topics.collect()) == sorted(m.document_topics(corpus.entries).collect())
    loose = m.topics_of(corpus.entries, minimum_probability=0.2, minimum_phi_value=0.05)
    assert min(r.p for r in loose[0].collect()) >= 0.2 and loose[2].count() > values.count()
    kept = values.collect()
    assert kept and min(r.nphi for r in kept) >= 0.2 and words.count() == len(kept)
    assert m.with_params(per_word_topics=False)[corpus.entries].columns == ["doc_id", "topic", "p"]
