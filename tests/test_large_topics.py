"""Large vocabularies and many topics: co-grouped E step, block sums, random starts."""

import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.operators import estep as E
from multitopic.operators import state as S
from multitopic.operators.kernel import infer
from multitopic.operators.vectors import sum_vectors
from multitopic.plans.model import TopicModel
from multitopic.sources import corpus as C


@pytest.fixture(scope="module")
def small(spark):
    rows = [(d, d % 2, f"t{(d * 7 + j * j) % 23}", 1.0 + j % 3) for d in range(60) for j in range(1 + d % 9)]
    terms = spark.createDataFrame(rows, "doc_id BIGINT, type_id INT, term STRING, cnt DOUBLE")
    vocab = C.vocabulary(terms)
    return C.Corpus(C.encode(terms, vocab), vocab, 2)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_buckets_do_not_matter(spark, small, buckets, monkeypatch):
    base = TopicModel.create(small, k=4, init="assign", iterations=8)
    docs = spark.createDataFrame([(d,) for d in [*range(60), 999]], "doc_id BIGINT")
    want = {r.doc_id: np.array(r.gamma) for r in base.gamma(small.entries, docs).collect()}
    monkeypatch.setattr(E, "bucket_count", lambda *a: buckets)
    joined = base.with_params(strategy="join")
    got = {r.doc_id: np.array(r.gamma) for r in joined.gamma(small.entries, docs).collect()}
    assert got.keys() == want.keys() and max(np.abs(got[d] - want[d]).max() for d in want) < 1e-9
    a, _, n, _ = base.sstats(small.entries)
    b, _, m, _ = joined.sstats(small.entries)
    one, two = ({(r.type_id, r.term_id): np.array(r.vec) for r in x.collect()} for x in (a, b))
    assert n == m and one.keys() == two.keys() and max(np.abs(one[t] - two[t]).max() for t in one) < 1e-9


def test_no_topic_vector_is_shuffled_with_the_documents(spark, small):
    """Documents are dealt with ids only, and the vectors meet distinct (bucket, term) pairs."""
    m = TopicModel.create(small, k=4, init="assign", strategy="join")
    text = plan(m.rows(m.prepare(small.entries), "gamma"))
    lines = text.splitlines()
    top = next(i for i, x in enumerate(lines) if "FlatMapCoGroupsInArrow" in x)
    indent = lines[top + 1].index(":")
    docs = [x for x in lines[top + 1 :] if x[indent : indent + 1] == ":"]
    assert any("Exchange" in x and "bucket" in x for x in docs) and not any(re.search(r"\beb#", x) for x in docs)
    assert "HashAggregate(keys=[bucket" in text and re.search(r"\beb#", text)


def test_bucket_count_bounds_vectors():
    assert E.bucket_count(0, 0, 5, 8) == 1
    for entries, chunks, k, parts in ((10**6, 1, 100, 8), (10**9, 50, 100, 200), (10**12, 1, 2000, 10**4)):
        per = entries // chunks // E.bucket_count(entries, chunks, k, parts)
        assert per * 8 * k <= E.BUCKET_BYTES * 1.01


@pytest.mark.parametrize("keys,k", [(["type_id", "term_id"], 300), (["type_id"], 300), ([], 300), (["type_id", "term_id"], 5)])
def test_sums_of_wide_vectors(spark, keys, k, monkeypatch):
    monkeypatch.setattr("multitopic.operators.vectors.TASK_BYTES", 8 * k * 7)  # blocks of seven rows
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 9)), rng.normal(size=k).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "type_id INT, term_id INT, vec ARRAY<DOUBLE>").repartition(5)
    want = {}
    for t, w, v in rows:
        key = tuple({"type_id": t, "term_id": w}[c] for c in keys)
        want[key] = want.get(key, 0) + np.array(v)
    out = sum_vectors(df, keys, k)
    got = {tuple(r[c] for c in keys): np.array(r["vec"]) for r in out.collect()}
    assert got.keys() == want.keys() and max(np.abs(got[x] - want[x]).max() for x in want) < 1e-9
    assert [f.dataType.simpleString() for f in out.schema][:-1] == ["int"] * len(keys)
    if k > 256:
        assert "sum(vec[" not in plan(out)


def test_estep_with_many_topics(spark, small):
    k = 2000
    m = TopicModel.create(small, k=k, init="assign", iterations=3)
    ss, elog, n, _ = m.sstats(small.entries)
    total = {r.type_id: sum(r.vec) for r in sum_vectors(ss, ["type_id"], k).collect()}
    want = {r.type_id: r.c for r in small.entries.groupBy("type_id").agg(F.sum("cnt").alias("c")).collect()}
    assert n == 60 and len(elog) == k
    assert all(abs(total[t] - want[t]) < 1e-2 for t in want)  # every token is dealt to topics in full


@pytest.mark.parametrize("kw", [{}, {"strategy": "join"}, {"max_doc_terms": 3}, {"strategy": "join", "max_doc_terms": 3}])
def test_random_gamma_start(spark, small, kw):
    """Draws go by (seed, document, topic): the same in every strategy."""
    m = TopicModel.create(small, k=4, init="assign", iterations=2, gamma_start="random", seed=5, **kw)
    got = {r.doc_id: np.array(r.gamma) for r in m.gamma(small.entries).collect()}
    eb = {(r.type_id, r.term_id): np.array(r.eb) for r in m.exp_elogbeta().collect()}
    start = {r.doc_id: np.array(r.g) for r in small.entries.select("doc_id").distinct().select("doc_id", S.gamma_draws("'doc', doc_id", 4, 5).alias("g")).collect()}
    assert len({tuple(g) for g in start.values()}) == 60 and abs(np.mean(list(start.values())) - 1) < 0.05
    bags = {}
    for r in small.entries.collect():
        bags.setdefault(r.doc_id, []).append(r)
    for d, bag in bags.items():
        g, *_ = infer(np.array([len(bag)]), np.array([r.cnt for r in bag]), np.array([eb[r.type_id, r.term_id] for r in bag]),
                      m.alpha, 2, 2, m.params.gamma_threshold, m.params.epsilon, start[d][None, :])
        assert np.abs(g[0] - got[d]).max() < 1e-9
    with pytest.raises(ValueError):
        m.with_params(gamma_start="zeros").gamma(small.entries)
