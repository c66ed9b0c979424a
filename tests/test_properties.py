"""Properties of the operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.operators import state as S
from multitopic.operators.compare import diff
from multitopic.operators.topics import choose_topics
from multitopic.plans.model import TopicModel, init_alpha, init_eta
from multitopic.sources import corpus as C

from .fixtures import docs_df, entries, g2_model, mats_from_state, vocab

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def purchases(spark):
    terms = C.purchases(spark, SF)
    return C.Corpus.build(terms)


def test_sstats_conserve_tokens(spark):
    m = g2_model(spark)
    ss, _, _, _ = m.sstats(prep=m.prepare(entries(spark), docs_df(spark)))
    mats = mats_from_state(ss.withColumnRenamed("vec", "s"), [3, 2])
    assert abs(mats[0].sum() - 9) < 1e-5 and abs(mats[1].sum() - 6) < 1e-5


def test_empty_doc_gets_alpha(spark):
    m = g2_model(spark)
    g = {r["doc_id"]: r["gamma"] for r in m.gamma(entries(spark), docs_df(spark, [1, 3, 99])).collect()}
    assert np.allclose(g[3], [0.5, 0.5]) and np.allclose(g[99], [0.5, 0.5])


def test_strategies_and_hot_path_agree(spark, purchases):
    base = TopicModel.create(purchases, k=4, init="assign", iterations=8)
    ref = {r["doc_id"]: np.array(r["gamma"]) for r in base.gamma(purchases.entries).collect()}
    for kw in ({"strategy": "join"}, {"max_doc_terms": 40}, {"strategy": "join", "max_doc_terms": 40}):
        m = base.with_params(**kw)
        m._eb, m._eb_bc = None, None
        got = {r["doc_id"]: np.array(r["gamma"]) for r in m.gamma(purchases.entries).collect()}
        assert got.keys() == ref.keys()
        assert max(np.abs(got[d] - ref[d]).max() for d in ref) < 1e-9, kw


def test_partition_count_independent(spark, purchases):
    m = TopicModel.create(purchases, k=3, init="assign", iterations=5)
    a = {r["doc_id"]: r["gamma"] for r in m.gamma(purchases.entries.repartition(1)).collect()}
    b = {r["doc_id"]: r["gamma"] for r in m.gamma(purchases.entries.repartition(13)).collect()}
    assert max(np.abs(np.array(a[d]) - np.array(b[d])).max() for d in a) < 1e-9


def test_theta_and_topics_normalised(spark, purchases):
    m = TopicModel.create(purchases, k=3, init="assign", iterations=5)
    th = m.transform(purchases.entries).select(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert th.agg(F.max(F.abs(F.col("s") - 1))).collect()[0][0] < 1e-12
    p = m.topic_term_dists().select("type_id", F.posexplode("p").alias("k", "p")).groupBy("type_id", "k").agg(F.sum("p").alias("s"))
    assert p.agg(F.max(F.abs(F.col("s") - 1))).collect()[0][0] < 1e-12


def test_merge_commutes(spark, purchases):
    a = TopicModel.create(purchases, k=3, init="assign").state
    b = TopicModel.create(purchases, k=3, init="assign", assign_rule="div").state
    ab = {(r.type_id, r.term_id): r.s for r in S.merge(a, b, 3).collect()}
    ba = {(r.type_id, r.term_id): r.s for r in S.merge(b, a, 3).collect()}
    assert ab == ba


def test_merge_associates(spark, purchases):
    a = TopicModel.create(purchases, k=3, init="assign").state
    b = TopicModel.create(purchases, k=3, init="assign", assign_rule="div").state
    c = S.random_state(purchases.vocab, 3, 0.1, seed=4)
    left = {(r.type_id, r.term_id): np.array(r.s) for r in S.merge(S.merge(a, b, 3), c, 3).collect()}
    right = {(r.type_id, r.term_id): np.array(r.s) for r in S.merge(a, S.merge(b, c, 3), 3).collect()}
    assert left.keys() == right.keys() and max(np.abs(left[t] - right[t]).max() for t in left) < 1e-9


def test_self_difference(spark, purchases):
    m = TopicModel.create(purchases, k=3, init="assign")
    kl = diff(m, m, "kullback_leibler", annotation=False, normed=False, diagonal=True).collect()
    assert all(abs(r["z"]) < 1e-12 for r in kl)
    rd = diff(m, m, "rescale_dot", annotation=False, normed=False, diagonal=True).collect()
    assert all(abs(r["z"] - 1) < 1e-9 for r in rd)


def test_kl_equals_mean_of_per_type_kl(spark):
    m1 = g2_model(spark)
    z = {(r.topic1, r.topic2): r.z for r in diff(m1, m1.with_params(), "kullback_leibler", annotation=False, normed=False).collect()}
    lam = [np.array([[4.5, 1.5, 0.5], [0.5, 2.5, 3.5]]), np.array([[3.5, 0.5], [1.5, 2.5]])]
    p = [l / l.sum(axis=1, keepdims=True) for l in lam]
    per = np.mean([np.sum(pt[0] * np.log(pt[0] / pt[1])) for pt in p])
    assert abs(z[(0, 1)] - per) < 1e-12


def test_priors():
    a, opt = init_alpha("asymmetric", 4)
    assert not opt and abs(a.sum() - 1) < 1e-12 and a[0] > a[-1]
    assert init_alpha("auto", 4)[1] and init_eta("auto", 4)[1]
    with pytest.raises(ValueError):
        init_eta("asymmetric", 4)
    with pytest.raises(ValueError):
        init_alpha([1.0, 2.0], 3)


def test_choose_topics():
    alpha = np.array([0.3, 0.1, 0.2, 0.5, 0.4])
    assert choose_topics(alpha, 3) == [1, 4, 3]
    assert choose_topics(alpha, 0) == [1, 2, 0, 4, 3]
    assert choose_topics(alpha, 10) == [0, 1, 2, 3, 4]
    assert choose_topics(alpha, -1) == [0, 1, 2, 3, 4]


def test_errors(spark, purchases):
    m = TopicModel.create(purchases, k=3, init="assign")
    m4 = TopicModel.create(purchases, k=4, init="assign")
    with pytest.raises(ValueError):
        diff(m, m, "cosine")
    with pytest.raises(ValueError):
        diff(m, m4, "hellinger", diagonal=True)
    with pytest.raises(TypeError):
        diff(m, "not a model")
    bad = spark.createDataFrame([(1, 0, "zzz-unknown", 1.0)], "doc_id BIGINT, type_id INT, term STRING, cnt DOUBLE")
    with pytest.raises(ValueError):
        C.encode(bad, purchases.vocab, strict=True)
    assert C.encode(bad, purchases.vocab, strict=False).count() == 0
    with pytest.raises(ValueError):
        C.num_terms(vocab(spark), 3)


def test_duplicate_rows_are_summed(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 1.0)], "d BIGINT, t STRING, w DOUBLE")
    got = {(r.doc_id, r.term): r.cnt for r in C.corpus_from_table(df, "d", "t", 0, "w").collect()}
    assert got == {(1, "a"): 3.0, (2, "b"): 1.0}


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "doc_id")
    idx = sorted((r.doc_id, r.idx) for r in C.dense_index(df, ["doc_id"], "idx", partitions=5).collect())
    assert [i for _, i in idx] == list(range(len(idx)))


def test_reset_and_small_shapes(spark, purchases):
    z = S.zero_state(purchases.vocab, 3, 0.1)
    assert z.select(F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.max("t")).collect()[0][0] == 0.0
    # K = 1: every document is all topic 0
    m1 = TopicModel.create(purchases, k=1, init="assign", iterations=3)
    assert {tuple(r.theta) for r in m1.transform(purchases.entries).collect()} == {(1.0,)}
    # T = 1 (one type only) runs as plain online LDA
    one = purchases.entries.where(F.col("type_id") == 0)
    c1 = C.Corpus(one, purchases.vocab.where(F.col("type_id") == 0), 1)
    m = TopicModel.create(c1, k=2, init="assign", iterations=3)
    assert m.num_types == 1 and m.gamma(one).count() == one.select("doc_id").distinct().count()


def test_too_few_updates_warns(spark):
    from multitopic.plans.train import update

    from .fixtures import g2_model

    m = g2_model(spark)
    with pytest.warns(UserWarning, match="model updates are planned"):
        update(m, entries(spark), docs=docs_df(spark), chunksize=4, passes=1, eval_every=0)


def test_custom_distance(spark, purchases):
    from multitopic.operators.compare import register_distance

    def same(m1, m2):
        return m1.spark.range(m1.k * m2.k).select((F.col("id") / m2.k).cast("int").alias("topic1"),
                                                  F.pmod("id", F.lit(m2.k)).cast("int").alias("topic2"), F.lit(1.0).alias("z"))

    register_distance("ones", same)
    m = TopicModel.create(purchases, k=2, init="assign")
    assert {r.z for r in diff(m, m, "ones", annotation=False).collect()} == {1.0}


def test_vectors_round_trip_sparse_and_dense(spark):
    """Sparse vectors are read without densifying; dense vectors give
    their non-zero positions; the Parquet vector sink reads back equal."""
    from pyspark.ml.linalg import DenseVector, SparseVector

    from multitopic.session import scratch_path

    df = spark.createDataFrame(
        [(1, SparseVector(1_000_000_000, [3, 999_999_999], [2.0, 5.0])), (2, DenseVector([0.0, 1.5, 0.0, 4.0])), (3, SparseVector(7, [], []))],
        ["doc_id", "v"],
    )
    got = sorted(tuple(r) for r in C.corpus_from_vectors(df, "doc_id", "v", 1).collect())
    assert got == [(1, 1, "3", 2.0), (1, 1, "999999999", 5.0), (2, 1, "1", 1.5), (2, 1, "3", 4.0)]

    ent = entries(spark)
    vec = C.to_vectors(ent, vocab(spark), 0, scratch_path(spark, "test-vectors"))
    back = C.corpus_from_vectors(vec, "doc_id", "vec", 0)
    want = ent.where("type_id = 0").select("doc_id", F.col("term_id").cast("string").alias("term"), "cnt")
    assert sorted(tuple(r) for r in back.select("doc_id", "term", "cnt").collect()) == sorted(tuple(r) for r in want.collect())
    sizes = {r["doc_id"]: r["vec"].size for r in vec.collect()}
    assert set(sizes.values()) == {C.num_terms(vocab(spark))[0]}


def _plain_lda_gamma(lam, docs, alpha, iters, thr, eps):
    """Independent plain (one-type) LDA E step in NumPy, textbook order."""
    from multitopic.functions.special import dirichlet_expectation_np

    eb = np.exp(dirichlet_expectation_np(lam))
    out = {}
    for d, es in docs.items():
        k = lam.shape[0]
        g = np.ones(k)
        if not es:
            out[d] = alpha + 0 * g
            continue
        ids = np.array([w for _, w, _ in es])
        cts = np.array([c for _, _, c in es])
        et = np.exp(dirichlet_expectation_np(g))
        ebd = eb[:, ids]
        phinorm = et @ ebd + eps
        for _ in range(iters):
            last = g
            g = alpha + et * ((cts / phinorm) @ ebd.T)
            et = np.exp(dirichlet_expectation_np(g))
            phinorm = et @ ebd + eps
            if np.mean(np.abs(g - last)) < thr:
                break
        out[d] = g
    return out


def test_one_type_equals_plain_lda(spark):
    """SURVEY 5.3: with T = 1 the multi-type E step is ordinary LDA."""
    from .fixtures import DOCS, LAM0, state_from

    docs = {d: [e for e in es if e[0] == 0] for d, es in DOCS.items()}
    ent = entries(spark, docs)
    voc = vocab(spark).where("type_id = 0")
    m = TopicModel.create(C.Corpus(ent, voc, 1), k=2, alpha=0.5, eta=0.5, init="given", state=state_from(spark, [LAM0]),
                          iterations=20, gamma_threshold=1e-6)
    got = {r["doc_id"]: np.array(r["gamma"]) for r in m.gamma(ent, docs_df(spark)).collect()}
    want = _plain_lda_gamma(LAM0, docs, 0.5, 20, 1e-6, m.params.epsilon)
    assert got.keys() == want.keys()
    assert max(np.abs(got[d] - want[d]).max() for d in want) < 1e-10


def test_hellinger_squares_add_over_types(spark):
    """Hellinger on concatenated types: H^2 = sum over types of H_t^2."""
    m1 = g2_model(spark)
    z = {(r.topic1, r.topic2): r.z for r in diff(m1, m1.with_params(), "hellinger", annotation=False, normed=False).collect()}
    lam = [np.array([[4.5, 1.5, 0.5], [0.5, 2.5, 3.5]]), np.array([[3.5, 0.5], [1.5, 2.5]])]
    p = [l / l.sum(axis=1, keepdims=True) for l in lam]
    h2 = sum(0.5 * np.sum((np.sqrt(pt[0]) - np.sqrt(pt[1])) ** 2) for pt in p)
    assert abs(z[(0, 1)] ** 2 - h2) < 1e-12 and abs(z[(0, 0)]) < 1e-9


def test_recovers_planted_topics(spark):
    """SURVEY 5.5: documents sampled from known topics; every planted topic
    is matched by a learned one with rescaled dot > 0.9."""
    from multitopic.plans.train import update

    from .fixtures import state_from

    k, w, n_docs = 3, 12, 300
    rng = np.random.default_rng(5)
    topics = np.full((k, w), 1e-3)
    for i in range(k):
        topics[i, 4 * i: 4 * i + 4] = 1.0
    topics /= topics.sum(axis=1, keepdims=True)
    rows = []
    for d in range(n_docs):
        theta = rng.dirichlet([0.2] * k)
        counts = rng.multinomial(40, theta @ topics)
        rows += [(d, 0, int(t), float(c)) for t, c in enumerate(counts) if c > 0]
    ent = spark.createDataFrame(rows, "doc_id BIGINT, type_id INT, term_id INT, cnt DOUBLE")
    voc = spark.createDataFrame([(0, i, f"w{i}", 1, 1.0) for i in range(w)],
                                "type_id INT, term_id INT, term STRING, doc_freq BIGINT, coll_freq DOUBLE")
    corp = C.Corpus(ent, voc, 1)
    m = TopicModel.create(corp, k=k, init="random", seed=2, alpha=0.2, eta=0.01, iterations=50)
    update(m, ent, chunksize=n_docs, passes=12, update_every=1, eval_every=0)
    truth = TopicModel.create(corp, k=k, init="given", eta=0.0,
                              state=state_from(spark, [topics * 1000.0], eta=0.0, subtract_eta=False))
    z = diff(truth, m, "rescale_dot", annotation=False, normed=False).toPandas()
    best = z.groupby("topic1")["z"].max()
    assert len(best) == k and (best > 0.9).all(), best.to_dict()


def test_hot_terms_split_join_equals_plain_join(spark):
    """A term in every document is split off the shuffle joins (encoding
    and the join-strategy E step); results equal the plain joins."""
    from multitopic.operators.skew import hot_keys

    rows = ([(d, 0, "common", 1.0) for d in range(200)] + [(d, 0, f"t{d % 17}", 2.0) for d in range(200)]
            + [(d, 1, f"u{d % 5}", 1.0) for d in range(200)])
    terms = spark.createDataFrame(rows, "doc_id BIGINT, type_id INT, term STRING, cnt DOUBLE")
    voc = C.vocabulary(terms)
    hot = hot_keys(voc, ["type_id", "term"], 8)
    assert hot is not None and {r.term for r in hot.collect()} == {"common"}
    enc = C.encode(terms, voc)
    plain = terms.join(voc.select("type_id", "term", "term_id"), ["type_id", "term"]).select("doc_id", "type_id", "term_id", "cnt")
    assert sorted(map(tuple, enc.collect())) == sorted(map(tuple, plain.collect()))
    corp = C.Corpus(enc, voc, 2)
    base = TopicModel.create(corp, k=3, init="assign", iterations=6)
    ref = {r["doc_id"]: np.array(r["gamma"]) for r in base.gamma(enc).collect()}
    mj = base.with_params(strategy="join")
    assert mj.hot_terms() is not None
    got = {r["doc_id"]: np.array(r["gamma"]) for r in mj.gamma(enc).collect()}
    assert got.keys() == ref.keys() and max(np.abs(got[d] - ref[d]).max() for d in ref) < 1e-9


def test_nest_returns_exactly_the_listed_documents(spark):
    """Listed documents without entries get an empty bag; entries of
    unlisted documents are left out; one shuffle (no join) in the plan."""
    from multitopic.operators.estep import nest

    e = entries(spark)
    got = {r.doc_id: sorted((x.type_id, x.term_id, x.cnt) for x in r.bag) for r in nest(e, docs_df(spark, [2, 3, 99])).collect()}
    assert got == {2: [(0, 2, 4.0)], 3: [], 99: []}
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        nest(e, docs_df(spark, [2, 3]), keys=("doc_id",)).explain()
    assert "Join" not in buf.getvalue() and buf.getvalue().count("Exchange") == 1


def test_spread_only_small_scans(spark):
    """A scan with fewer partitions than task slots is spread over all
    slots; one with enough partitions is left as is (no shuffle)."""
    slots = spark.sparkContext.defaultParallelism
    small = spark.range(0, 100, 1, 1)
    assert C.spread(small).rdd.getNumPartitions() == slots
    big = spark.range(0, 100, 1, slots + 3)
    assert C.spread(big) is big
