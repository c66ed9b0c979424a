import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from multitopic.llm import decontam as D

from . import messy


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = messy.alnum_words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = {}
    for i, text in docs:
        w = messy.alnum_words(text)
        hit, met = set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if (found := grams.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    met |= found
        ids = ",".join(sorted(str(x) for x in met))
        out[i] = (len(w), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def tables():
    rng = random.Random(3)
    items = [(k, " ".join(messy.sentence(rng, n, 60))) for k, n in enumerate([25, 12, 10, 9, 3, 2, 40, 11, 30])]
    items += [(50, items[0][1]), (51, items[1][1] + " and more"), (52, None), (53, " .,"), (54, "été ÉTÉ")]
    docs = messy.documents()
    for k in range(60):
        body = messy.sentence(rng, 30, 60)
        w = (rng.choice(items)[1] or "").split()
        a = rng.randrange(max(1, len(w)))
        docs.append((10_000 + k, " ".join(body + w[a : a + rng.randrange(1, 40)] + body[::-1]).upper() if k % 2 else ", ".join(body + w + body)))
    return docs, items


@pytest.mark.parametrize("shard_words", [100_000, 30])
def test_hits_match_brute_force(spark, shard_words):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination_report(messy.frame(spark, docs), bench, shard_words=shard_words).collect()}
    want = brute(docs, items)
    assert got == want and sum(x[4] for x in want.values()) > 30


def test_clean_texts_have_no_hit_left(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = messy.frame(spark, docs)
    clean = D.remove_spans(df, bench)
    assert clean.columns == df.columns
    rows = {r.doc_id: r.text for r in clean.collect()}
    want = brute(docs, items)
    assert set(rows) == {i for i, (n, hit, *_) in want.items() if hit <= 0.5 * n}
    for i, t in docs:
        if i in rows and not want[i][4]:
            assert rows[i] == t
    assert not any(x[4] for x in brute(rows.items(), items).values())
    left = Counter(messy.alnum_words(" ".join(t or "" for t in rows.values())))
    assert not left - Counter(messy.alnum_words(" ".join(t or "" for _, t in docs)))


def test_empty_tables_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, "a b"), (2, "a b")], "doc_id bigint, text string")
    items = "item_id bigint, text string"
    assert [r.n_hit for r in D.contamination_report(docs, spark.createDataFrame([], items)).collect()] == [0] * 4
    bench = spark.createDataFrame([(None, "A b"), (7, "a B")], items)
    got = sorted((str(r.doc_id), r.n_hit, r.n_items) for r in D.contamination_report(docs, bench).collect())
    assert got == [("1", 0, 0), ("2", 2, 2), ("2", 2, 2), ("None", 2, 2)]
    assert D.contamination_report(docs.where("false"), bench).count() == 0


def test_automaton_lengths_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        items = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 6))]
        window = rng.randrange(1, 7)
        a = D.ItemAutomaton([(k, np.array(x, dtype=np.uint64), True) for k, x in enumerate(items)], window)
        stream = [rng.randrange(5) for _ in range(60)]
        ids = [int(np.searchsorted(a.vocab, c)) if c in a.vocab.tolist() else 10**12 for c in stream]
        spans, met = a.stream(ids)
        hit = {k for x, y in spans for k in range(x, y)}
        want_hit, want_met = set(), set()
        for k, x in enumerate(items):
            m = min(window, len(x))
            grams = {tuple(x[j : j + m]) for j in range(len(x) - m + 1)}
            for j in range(len(stream) - m + 1):
                if tuple(stream[j : j + m]) in grams:
                    want_hit |= set(range(j, j + m))
                    want_met.add(k)
        assert (hit, met) == (want_hit, want_met)


def test_shards_change_no_cleaned_text(spark):
    rng = random.Random(31)
    docs, items = tables()
    a, b = messy.sentence(rng, 12), messy.sentence(rng, 12)
    items += [(60, " ".join(a)), (61, " ".join(b))]
    body = messy.sentence(rng, 16)
    docs += [
        (20_001, " ".join(a + body + b)),  # 30 % and 30 % in two items
        (20_002, " ".join(messy.sentence(rng, 40) + a[:6] + b + a[6:] + messy.sentence(rng, 40))),  # one cut makes the other passage
        (20_003, " ".join(messy.sentence(rng, 40) + b[:6] + a + b[6:] + messy.sentence(rng, 40))),
        (None, None), (None, docs[-1][1]), (20_001, "another text"),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = messy.frame(spark, docs)
    got = [sorted(map(str, D.remove_spans(df, bench, shard_words=n).collect())) for n in (100_000, 30)]
    assert got[0] == got[1]
    rows = [(r.doc_id, r.text) for r in D.remove_spans(df, bench, shard_words=30).collect()]
    assert [t for i, t in rows if i == 20_001] == ["another text"] and {20_002, 20_003} <= {i for i, _ in rows}
    assert not any(x[4] for x in brute(enumerate(t for _, t in rows), items).values())
    assert D.remove_spans(df.where("false"), bench, shard_words=30).count() == 0
    assert D.remove_spans(df.where("doc_id = 20001 AND text = 'another text'"), bench, shard_words=30).columns == df.columns
