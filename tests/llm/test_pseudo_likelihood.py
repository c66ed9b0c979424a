import random
from collections import Counter

import numpy as np
import pytest

from multitopic.llm import pseudo_likelihood as P
from multitopic.llm.text import ALNUM, slices, words

from . import messy


def softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def brute(net, leaves):
    """Log probability of every token of a text, from the formulas alone."""
    net = net.astype(float)
    out = []
    for k, leaf in enumerate(leaves):
        z = net[P._HID, : P.DIM].copy()
        for j, off in enumerate(P.OFFSETS):
            near = leaves[k + off] if 0 <= k + off < len(leaves) else P.VOCAB
            z += net[j * (P.VOCAB + 1) + near, : P.DIM]
        h = np.tanh(z)
        a, b = net[P._A : P._B], net[P._B : P._C]
        c1, c2 = divmod(leaf, P.SIDE)
        p1 = softmax(a[:, : P.DIM] @ h + a[:, P.DIM])
        p2 = softmax(b[:, : P.DIM] @ (h + net[P._C + c1, : P.DIM]) + b[:, P.DIM])
        out.append(np.log(p1[c1]) + np.log(p2[c2]))
    return out


def leaves_of(rows):
    """Leaf of every word of the corpus, by plain counting."""
    import pyarrow as pa

    count = Counter(w for _, t in rows for w in messy.alnum_words(t))
    hashed = {}
    for w in count:
        (s,) = slices(pa.array([w]))
        hashed[w] = int(words(s, ALNUM).hash[0])
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    top = sorted(count, key=lambda w: (-count[w], signed(hashed[w])))[: P.FREQUENT]
    rank = {w: k for k, w in enumerate(top)}
    return {w: rank.get(w, P.FREQUENT + hashed[w] % (P.VOCAB - P.FREQUENT)) for w in count}


def random_net(seed=1):
    net = P.initial()
    net[:, : P.WIDTH] += np.random.default_rng(seed).normal(0, 0.3, net.shape).astype(np.float32)
    return net


@pytest.mark.parametrize("block", [P.BLOCK, 5000])
def test_scores_match_brute_force(spark, block):
    rows = [r for r in messy.documents() if len(r[1] or "") < 3000] + [(None, "a b a"), (None, None), (7, "x"), (7, "x"), (7, "y y")]
    leaf, net = leaves_of(rows), random_net()
    docs = messy.frame(spark, rows)
    blocks = P.token_blocks(docs, P.frequent_words(docs), block=block)
    got = [(str(r.doc_id), r.n_tokens, r.pll, r.mean_pll) for r in P.score_blocks(blocks, net).collect()]
    want = []
    for i, t in rows:
        p = brute(net, [leaf[w] for w in messy.alnum_words(t)])
        want.append((str(i), len(p), sum(p), sum(p) / len(p) if p else None))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (x[0], x[1], x[2])), sorted(want, key=lambda x: (x[0], x[1], x[2]))):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-3, rel=1e-4)
        assert (g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) < 1e-3)


def test_gradients_match_differences():
    net, rng = random_net(2), np.random.default_rng(3)
    leaves = rng.integers(0, P.VOCAB, 9)
    texts = P.Texts(leaves, np.array([9]))
    token, ctx = texts.pairs(np.arange(9))
    dense, dh, d2 = P.Learner(net).gradients(token, ctx)
    loss = lambda n: -sum(brute(n, leaves.tolist()))
    def slope(row, col):
        up, down = net.astype(float), net.astype(float)
        up[row, col] += 1e-4
        down[row, col] -= 1e-4
        return (loss(up) - loss(down)) / 2e-4
    for col in (0, 7, 15):
        assert slope(P._HID, col) == pytest.approx(dense["hid"][0, col], abs=2e-3)
        assert slope(P._A + 5, col) == pytest.approx(dense["a"][5, col], abs=2e-3)
        assert slope(P._B + 9, col) == pytest.approx(dense["b"][9, col], abs=2e-3)
        c1 = int(token[4]) // P.SIDE
        assert slope(P._C + c1, col) == pytest.approx(d2[token // P.SIDE == c1, col].sum(), abs=2e-3)
        for j in range(4):
            row = ctx[3, j]
            assert slope(row, col) == pytest.approx(dh[ctx[:, j] == row, col].sum(), abs=2e-3)
    assert slope(P._A + 5, P.DIM) == pytest.approx(dense["a"][5, P.DIM], abs=2e-3)


def chain(rng, n):
    out, w = [], 0
    for _ in range(n):
        w = (w * 3 + rng.choice([1, 2])) % 40
        out.append(f"v{w}")
    return out


def test_training_prefers_the_language_it_saw(spark):
    rng = random.Random(11)
    docs = [(k, " ".join(chain(rng, 200))) for k in range(400)]
    natural = [chain(rng, 200) for _ in range(20)]
    mixed = [rng.sample(x, len(x)) for x in natural]
    held = [(1000 + k, " ".join(x)) for k, x in enumerate(natural + mixed)]
    got = P.pseudo_likelihood(spark.createDataFrame(docs + held, "doc_id bigint, text string").repartition(3))
    mean = {r.doc_id: r.mean_pll for r in got.collect()}
    assert min(mean[1000 + k] for k in range(20)) > max(mean[1000 + k] for k in range(20, 40))
    assert np.mean([mean[k] for k in range(400)]) > -8.3 + 2


def test_partitions_do_not_matter(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(k, " ".join(chain(rng, 100))) for k in range(200)], "doc_id bigint, text string")
    one, six = ({r.doc_id: r.pll for r in P.pseudo_likelihood(df.repartition(n), block=4000).collect()} for n in (1, 6))
    assert one.keys() == six.keys() and all(abs(one[k] - six[k]) < 0.05 for k in one)


def test_equal_rows_are_dealt_round(spark):
    """Many equal rows fill several blocks, and every row has the same score."""
    df = spark.createDataFrame([(None, "a b c d e f g h")] * 600 + [(k, f"z{k}") for k in range(50)], "doc_id bigint, text string").repartition(4)
    blocks = P.token_blocks(df, P.frequent_words(df), block=500)
    sizes = [len(r.tokens) // 2 for r in blocks.collect()]
    assert sum(sizes) == 4850 and max(sizes) < 2000 and len(sizes) > 4
    got = P.score_blocks(blocks, random_net()).where("doc_id IS NULL").collect()
    assert len(got) == 600 and max(r.pll for r in got) - min(r.pll for r in got) < 1e-3


def test_every_token_is_a_target_once():
    seen = np.concatenate([np.flatnonzero(P.Texts(np.arange(40), np.array([40])).place % P.MASK_EVERY == k % P.MASK_EVERY) for k in range(P.MASK_EVERY)])
    assert np.sort(seen).tolist() == list(range(40))


def test_empty_table(spark):
    assert P.pseudo_likelihood(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")
    assert [(r.n_tokens, r.pll, r.mean_pll) for r in P.pseudo_likelihood(nulls).collect()] == [(0, 0.0, None)] * 2
