import math
import random

import numpy as np
import pyarrow as pa
import pytest

from multitopic.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, row string, id string"
LONG = 2**63 - 1


def brute(rows, every=100, positives=5, negatives=10):
    """Rows of the result, sorted; every row of the input is a candidate by itself."""
    clamp = lambda x: max(-LONG - 1, min(LONG, x))
    usable = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, [clamp(math.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for k, (a, v, label) in enumerate(usable):
        if a is None or a % every:
            continue
        dot = lambda q, v=v: clamp(sum(x * y for x, y in zip(v, q, strict=False)))
        ranked = sorted(((-dot(q), i is None, i or 0, n) for n, (i, q, _) in enumerate(usable) if n != k))
        for s, none, i, _ in [r for r in ranked if usable[r[3]][2] == label][:positives]:
            p = -s
            far = [r for r in ranked if usable[r[3]][2] != label and 30 * p <= -100 * r[0] <= 90 * p][:negatives]
            out += [(a, None if none else i, rank, None if n else j, p, -t) for rank, (t, n, j, _) in enumerate(far, 1)]
    return sorted(out, key=str)


def vectors(n, dims=6, seed=1, scale=1.0):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, scale) + (k % 3) * scale / 2 for _ in range(dims)], k % 3) for k in range(n)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "s", "r", "i") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in H.mine_negatives(df, **kw).collect()), key=str)


def test_matches_brute_force(spark):
    rows = vectors(700)
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, rows) == want


def test_shards_and_small_blocks(spark, monkeypatch):
    rows = vectors(900, seed=2)
    assert run(spark, rows, shard_bytes=8 * 6 * 2) == brute(rows)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rows = vectors(300, dims=4, seed=3)
    hot = [0.5, 0.5, 0.25, 0.0]
    rows += [(1000 + k, hot, k % 4) for k in range(200)]  # one very common vector, also an anchor
    rows += [(100, [0.1, 0.2, 0.3, 0.4], 1), (100, [0.1, 0.2, 0.3, 0.4], 1), (100, [0.9, 0.2, 0.3, 0.4], 2)]  # repeated anchors
    rows += [(None, hot, 0), (None, hot, 1), (None, [0.4, 0.4, 0.4, 0.4], 2)]
    rows += [(2000, None, 1), (2100, hot, None), (2200, [0.1, None, 0.2, 0.3], 1), (2300, [0.1, float("nan"), 0.0, 0.0], 1), (2400, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(2500, [], 1), (2600, [0.5], 2), (2700, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 0)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e5, 1e9, 3e14, 1e30])
def test_wide_components(spark, scale):
    """Components whose products leave doubles, longs, or both."""
    rows = vectors(220, dims=3, seed=4, scale=scale)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit,dims", [(1, 1), (255, 64), (300, 1000), (2**20, 64), (2**26, 3), (2**40, 5)])
def test_packed_products_are_exact(limit, dims):
    rng = np.random.default_rng(limit % 1000)
    lists = [rng.integers(-limit, limit + 1, dims).tolist() for _ in range(23)] + [[limit] * dims, [-limit] * dims, []]
    layout = H.Fields(limit, dims)
    assert layout.fields >= (1 if layout.exact else 8)
    m = layout.matrix(pa.array(lists, pa.list_(pa.int64())))
    got = layout.scores(m, layout.pack(m), m.sum(1))
    clamp = lambda x: max(-LONG - 1, min(LONG, x))
    assert got.tolist() == [[clamp(sum(x * y for x, y in zip(a, b, strict=False))) for b in lists] for a in lists]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5], 1)]) == []  # no anchor
    assert run(spark, [(100, [0.5], 1), (7, [0.5], 2)]) == []  # no positive
