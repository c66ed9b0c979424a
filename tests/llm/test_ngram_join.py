import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from multitopic.llm import ngram_join as J
from multitopic.llm.components import connected_components

from . import messy


def brute(rows):
    sets = {}
    for i, t in rows:
        w = messy.space_words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    common = Counter((a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("rare,hot,stars", [(64, 64, 2), (3, 64, 2), (64, 1, 0)])
def test_components_match_brute_force(spark, rare, hot, stars, monkeypatch):
    monkeypatch.setattr(J, "HOT", hot)  # signatures above it go by the longer keys
    monkeypatch.setattr(J, "STARS", stars)
    rows = messy.documents()
    got = {r[0]: (r[1], r[2]) for r in J.link_components(messy.frame(spark, rows), rare=rare).collect()}
    want = brute(rows)
    assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 25


def test_empty_null_and_shared_ids(spark):
    schema = "doc_id bigint, text string"
    assert J.link_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e"), (None, None), (4, "a b c d e"), (9, "a b c d e"), (9, "q r s t u"), (11, "q r s t u"), (12, None)]
    got = sorted(J.link_components(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, None), (None, None), (4, 4), (9, 4), (9, 9), (11, 9), (12, 12)])


def test_linked_sets_always_share_a_signature():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(6, 300)
        pool = rng.sample(range(1, 10**9), n + 80)
        x = pool[:n]
        drop = rng.randrange(0, J.allowed_misses(n, 85) + 1)
        y = rng.sample(x, n - drop) + pool[n : n + rng.randrange(0, 4)]
        common = len(set(x) & set(y))
        if 100 * common < 85 * (len(x) + len(y) - common) or len(y) < 6:
            continue
        df = {t: rng.choice([2, 2, 1000]) for t in pool}
        if rng.random() < 0.4:
            df = dict.fromkeys(pool, 1000)
        hot = {t for t in pool if rng.random() < 0.3}
        sigs = []
        for s in (x, y):
            order = sorted(set(s), key=lambda t: (t in hot, t))[: J.region_size(len(s), 85)]
            shared = [(k, t) for k, t in enumerate(order) if t in set(x) & set(y) or rng.random() < 0.5]
            at, token = np.array([k for k, _ in shared]), np.array([t for _, t in shared], dtype=np.uint64)
            sigs.append(set(J._document_signatures(at, token, np.array([df[t] for _, t in shared]), len(s), 85, 64).tolist()))
            assert len(sigs[-1]) <= 8 * len(s) + 8
        assert sigs[0] & sigs[1], (n, len(y), common)


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(100, 130)] + [(5, 3), (3, 9), (7, 7), (None, 4)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 131)}, 3: 3, 5: 3, 9: 3}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bitmap_bound_never_refuses_a_link(spark):
    rows = messy.documents(8)
    docs = messy.frame(spark, rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    got = [r for r in J.prefix_regions(docs, 4, 85, heavy).collect() if r.n >= 6]
    words = {i: messy.space_words(t) for i, t in rows}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in words.items()}
    for a, b in zip(got, got[1:]):
        diff = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a.bits, b.bits))
        assert diff <= len(sets[a.doc_id] ^ sets[b.doc_id])


def test_texts_of_one_template_share_no_crowded_key(spark, monkeypatch):
    """400 equal and 55 own words: similarity 0.78 links nothing, and the longer
    keys of the crowded signatures pair nothing either."""
    rng = random.Random(4)
    common = messy.sentence(rng, 400, 10**6)
    rows = [(k, " ".join(common + [f"o{k}x{j}" for j in range(55)])) for k in range(200)]
    crowds = []
    keys = J._prefix_keys
    monkeypatch.setattr(J, "_prefix_keys", lambda *a: crowds.append(keys(*a)) or crowds[-1])
    got = J.link_components(spark.createDataFrame(rows, "doc_id bigint, text string"), rare=16).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 452 for r in got)
    assert len(crowds) == 1 and crowds[0].count() == 0


def test_crowded_tokens_make_keys_of_occupied_bands_only(spark, monkeypatch):
    """A token's key needs another set with the token in the other size band."""
    rng = random.Random(77)
    shared = [f"t{k}" for k in range(30)]
    rows = [(k, " ".join([*shared, *(f"w{rng.random()}" for _ in range(30 + 40 * (k % 8)))])) for k in range(160)]
    twins = [(1000 + k, t + " more") for k, t in rows[::4]]
    monkeypatch.setattr(J, "HOT", 1)
    made, kept, write, keys = [], [], J.materialize, J._prefix_keys

    def noted(df, name="table"):
        out = write(df, name)
        if name == "crowd-keys":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", noted)
    monkeypatch.setattr(J, "_prefix_keys", lambda *a: kept.append(keys(*a)) or kept[-1])
    sets = spark.createDataFrame(rows + twins, "doc_id bigint, text string")
    regions = write(J.prefix_regions(sets, 4, 85, spark.sparkContext.broadcast(J.heavy_tokens(sets, 4))), "regions")
    nodes = regions.selectExpr("doc_id AS node", "d1", "d2", "n")
    J._prefix_keys(nodes.select("node"), regions, nodes, 85)
    assert kept[0].count() and made[0] <= 3 * kept[0].count()
    got = {r.doc_id: r.component_id for r in J.link_components(sets).collect()}
    assert all(got[1000 + k] == got[k] for k, _ in rows[::4])
