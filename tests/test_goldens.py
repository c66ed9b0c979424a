"""Hand-computed goldens G1-G6 (FIXTURES.md section D), tolerance 1e-8."""

import numpy as np
import pytest

from multitopic.operators import state as S
from multitopic.operators.compare import diff
from multitopic.operators.hyper import newton_step
from multitopic.plans.evaluate import bound, doc_part, perplexity
from multitopic.plans.model import TopicModel
from multitopic.plans.train import do_mstep, update
from multitopic.sources.corpus import Corpus

from .fixtures import LAM0, LAM1, docs_df, entries, g2_model, mats_from_state, state_from, vocab

TOL = 1e-8


def test_g1_newton():
    g = np.array([[5, 1], [2, 2], [9, 3]], dtype=float)
    from multitopic.functions.special import dirichlet_expectation_np

    logphat = dirichlet_expectation_np(g).mean(axis=0)
    assert np.allclose(logphat, [-0.44511784511784, -1.54551467051463], atol=1e-12)
    a5, ok = newton_step(np.array([0.5, 0.5]), 3, logphat, 0.5)
    assert ok and np.allclose(a5, [0.674589847027562, 0.563096338202093], atol=TOL)
    a1, _ = newton_step(np.array([0.5, 0.5]), 3, logphat, 1.0)
    assert np.allclose(a1, [0.849179694055124, 0.626192676404184], atol=TOL)


G2_GAMMA = {1: (3.396157374, 0.603841803), 2: (0.506690780, 2.493308628), 3: (0.5, 0.5), 4: (1.306810297, 2.193188707)}
G2_ROUNDS = {1: 9, 2: 4, 3: 2, 4: 7}
G2_SS0 = [[2.928829182, 0.873061675, 0.035938539], [0.071169798, 0.126937598, 4.964059870]]
G2_SS1 = [[3.515058244, 0.066586240], [0.484940975, 1.933413056]]


@pytest.mark.parametrize("strategy,max_terms", [("broadcast", None), ("join", None), ("broadcast", 2)])
def test_g2_estep(spark, strategy, max_terms):
    m = g2_model(spark, strategy=strategy, max_doc_terms=max_terms)
    g = {r["doc_id"]: r for r in m.gamma(entries(spark), docs_df(spark)).collect()}
    for d, exp in G2_GAMMA.items():
        assert np.allclose(g[d]["gamma"], exp, atol=1e-8), (d, g[d]["gamma"])
        assert g[d]["iters"] == G2_ROUNDS[d]
    prep = m.prepare(entries(spark), docs_df(spark))
    ss, _, n, _ = m.sstats(prep=prep)
    mats = mats_from_state(ss.withColumnRenamed("vec", "s"), [3, 2])
    assert np.allclose(mats[0], G2_SS0, atol=1e-8) and np.allclose(mats[1], G2_SS1, atol=1e-8)
    assert n == 4


def test_g2_theta(spark):
    m = g2_model(spark)
    t = {r["doc_id"]: r["theta"] for r in m.transform(entries(spark), docs_df(spark)).collect()}
    assert np.allclose(t[1], [0.849039518, 0.150960482], atol=1e-8)
    assert np.allclose(t[2], [0.168896960, 0.831103040], atol=1e-8)
    assert np.allclose(t[4], [0.373374477, 0.626625523], atol=1e-8)


def test_g3_bound(spark):
    m = g2_model(spark)
    prep = m.prepare(entries(spark), docs_df(spark))
    s, words, n = doc_part(m, prep)
    assert abs(s - (-15.001529097)) < 1e-6 and words == 15 and n == 4
    b = bound(m, prep=prep)
    assert abs(b - (-18.569016935)) < 1e-6
    pw = b / words
    assert abs(pw - (-1.237934462)) < 1e-8
    assert abs(perplexity(pw) - 2.358606037) < 1e-8


def test_g4_blend(spark):
    m = g2_model(spark)
    ss, _, n, _ = m.sstats(prep=m.prepare(entries(spark), docs_df(spark)))
    ones = state_from(spark, [np.ones((2, 3)), np.ones((2, 2))], eta=0.0, subtract_eta=False)
    out = S.blend(ones, ss, 0.75, 0.25 * 8 / n)
    mats = mats_from_state(out, [3, 2])
    assert np.allclose(mats[0], [[2.214414591, 1.186530837, 0.767969269], [0.785584899, 0.813468799, 3.232029935]], atol=1e-8)
    assert np.allclose(mats[1], [[2.507529122, 0.783293120], [0.992470487, 1.716706528]], atol=1e-8)


G5 = {
    "kullback_leibler": [[0.536701421, 0.044993849], [0.033525438, 0.549867976]],
    "hellinger": [[0.524797893, 0.156271105], [0.133456516, 0.543297905]],
    "jensen_shannon": [[0.131937382, 0.012102892], [0.008847773, 0.140568067]],
    "rescale_dot": [[0.382222222, 0.988235294], [0.992366412, 0.111776447]],
}


@pytest.mark.parametrize("distance", sorted(G5))
def test_g5_topic_difference(spark, distance):
    m1 = g2_model(spark)
    corp = Corpus(entries(spark), vocab(spark), 2)
    l2 = [np.array([[1.0, 2, 3], [4, 1, 1]]), np.array([[1.0, 1], [3, 1]])]
    m2 = TopicModel.create(corp, k=2, alpha=0.5, eta=0.5, init="given", state=state_from(spark, l2))
    z = {(r["topic1"], r["topic2"]): r["z"] for r in diff(m1, m2, distance, annotation=False, normed=False).collect()}
    for i in range(2):
        for j in range(2):
            assert abs(z[(i, j)] - G5[distance][i][j]) < 1e-8, (distance, i, j, z[(i, j)])


G6 = {
    "online": (
        [1, 0.707106781, 0.5, 0.5],
        [[2.542241501, 0.622358219, 0.041305677], [0.104203938, 0.024087812, 3.898033241]],
        [[2.788508518, 0.109355275], [0.504383956, 2.597750079]],
        [0.5, 0.5],
    ),
    "batch": (
        [1, 0.5],
        [[2.812068628, 0.937693087, 0.085548597], [0.187930309, 0.062306239, 4.914450053]],
        [[3.526270919, 0.152733450], [0.473728254, 1.847265896]],
        [0.5, 0.5],
    ),
    "auto": (
        [1, 0.707106781, 0.5, 0.5],
        [[2.535505475, 0.620216130, 0.040474966], [0.110939933, 0.026229895, 3.898863955]],
        [[2.761577095, 0.104469176], [0.531315371, 2.602636187]],
        [0.521058471, 0.561179594],
    ),
}


@pytest.mark.parametrize("case", sorted(G6))
def test_g6_training(spark, case):
    corp = Corpus(entries(spark), vocab(spark), 2)
    st = state_from(spark, [LAM0, LAM1], eta=0.5, subtract_eta=False)  # S = the G2 lambdas, lambda = S + 0.5
    m = TopicModel.create(corp, k=2, alpha="auto" if case == "auto" else 0.5, eta=0.5, init="given", state=st)
    m.alpha = np.array([0.5, 0.5])
    update(m, corp.entries, docs=docs_df(spark), chunksize=2, passes=2, update_every=0 if case == "batch" else 1, eval_every=0,
           decay=0.5, offset=1.0)
    rhos = [x["value"] for x in m.metrics if x["metric"] == "rho"]
    exp_rho, s0, s1, alpha = G6[case]
    assert np.allclose(rhos, exp_rho, atol=1e-8)
    mats = mats_from_state(m.state, [3, 2])
    assert np.allclose(mats[0], s0, atol=1e-8), mats[0]
    assert np.allclose(mats[1], s1, atol=1e-8), mats[1]
    assert np.allclose(m.alpha, alpha, atol=1e-8)
    assert m.num_updates == 4
