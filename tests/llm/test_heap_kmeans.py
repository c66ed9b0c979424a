import hashlib
import math
import random

import numpy as np
import pytest

from multitopic.llm import heap_kmeans as H

SCHEMA = "vec_id bigint, embedding array<float>, id string, cluster string"
LONG = 2**63 - 1


def brute(rows, dims, clusters=8, rounds=10):
    clamp = lambda x: max(-LONG - 1, min(LONG, x))
    kept = [
        (i, [clamp(math.floor(1024 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v, x: sum((a - b) ** 2 for a, b in zip(v, x, strict=True))
    assign = lambda: [min((far(v, x), j) for j, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, k) in zip(kept, at, strict=True) if k == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    inertia = {j: sum(min(d, LONG) for d, k in at if k == j) for j in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    total = min(LONG, sum(inertia.values()))
    return sorted(((i, j, min(d, LONG), min(LONG, inertia[j]), total, digest[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


def run(spark, rows, dims, partitions=3, **kw):
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in H.cluster_vectors(df, dims=dims, **kw).collect()), key=str)


def points(n, dims, seed, centers=9, spread=0.3, scale=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(centers)]
    return [(k, [x + rng.gauss(0, spread * scale) for x in rng.choice(middle)]) for k in range(n)]


@pytest.mark.parametrize("seed,dims,spread", [(1, 4, 0.3), (2, 2, 1.0), (3, 16, 0.6)])
def test_matches_lloyd(spark, seed, dims, spread, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 64)
    rows = points(600, dims, seed, spread=spread)
    assert run(spark, rows, dims) == brute(rows, dims)


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, partitions):
    rows = points(300, 3, 4, spread=2.0)
    assert run(spark, rows, 3, partitions) == brute(rows, 3)


def test_ties_repeats_nulls_and_left_out_vectors(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(60)]  # two places only: most clusters stay empty
    rows += [(None, [0.5, 0.0]), (None, [0.5, 0.0]), (3, [0.25, 0.25]), (3, [0.25, 0.25])]
    rows += [(70, None), (71, []), (72, [1.0]), (73, [1.0, None]), (74, [float("nan"), 0.0]), (75, [0.0, float("-inf")]), (76, [1.0, 2.0, 3.0])]
    got = run(spark, rows, 2)
    assert len(got) == 64
    assert got == brute(rows, 2)


@pytest.mark.parametrize("scale", [1e4, 1e12, 1e30])
def test_wide_components(spark, scale):
    rows = points(120, 3, 5, scale=scale)
    assert run(spark, rows, 3) == brute(rows, 3)


def test_few_vectors_and_empty_table(spark):
    rows = points(3, 2, 6)
    assert run(spark, rows, 2) == brute(rows, 2)
    assert run(spark, rows[:1], 2) == brute(rows[:1], 2)
    assert run(spark, [], 2) == []


def test_only_expired_gaps_are_scanned():
    """Heaps answer like a full scan, and most vectors are never looked at again."""
    rng = np.random.default_rng(7)
    middle = rng.integers(-3000, 3000, (8, 5))
    data = (middle[rng.integers(0, 8, 2000)] + rng.normal(0, 60, (2000, 5))).astype(np.int16)
    space = H.Space(4000, 5)
    centroids = [x.tolist() for x in data[:8].astype(int)]
    block, offsets = H.Block.fresh(data, 8), [0.0] * 8
    scanned = 0
    expired = block.expired
    means = H.Means(centroids)

    def counted(o):
        nonlocal scanned
        due = expired(o)
        scanned += len(due)
        return due

    block.expired = counted
    for _ in range(11):
        change = block.assign(space, means.centroids, means.offsets)
        full = space.distances(space.numbers(data), means.centroids).argmin(1)
        assert (block.cluster == full).all()
        for j, row in enumerate(change.tolist()):
            means.sums[j] = [a + b for a, b in zip(means.sums[j], row, strict=True)]

        class No:  # the sums are up to date already
            def select(self, *_):
                return self

            groupBy = agg = select

            def collect(self):
                return []

        means.update(No())
    assert scanned < 11 * 2000 * 0.6
    assert sum(map(len, block.heaps)) == 2000
    for heap in block.heaps:
        assert all(heap[(k - 1) // 2] <= heap[k] for k in range(1, len(heap)))
