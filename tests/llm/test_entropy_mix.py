import random

from multitopic.llm import entropy_mix as M

from . import messy


def fill(sizes, share=1.5, cap=2.0):
    """Targets by repeated resharing."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        left = total - sum(full.values())
        want = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: cap * sizes[s] for s in want if want[s] > cap * sizes[s]}
        if not over:
            return {**full, **want}
        full |= over


def test_targets_rates_and_copies(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(1) * 20))) for k in range(1500)] + messy.documents() + [(9000, None), (9001, "")]
    df = messy.frame(spark, rows)
    got = M.mix_sources(df).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(messy.space_words(t))) for i, t in rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 2 * r.size and 0 <= r.rate <= 2 and abs(r.copies - r.rate) < 1
    want = fill(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] + 1e-6
        assert abs(taken[s] - target[s]) < 0.02 * target[s] + 50
        own = [r for r in got if r.source == s]
        assert abs(sum(r.rate * r.size for r in own) - want[s]) < 1e-5 * want[s]
        inner = [r for r in own if r.size and 0 < r.rate < 2]  # log rate is linear in size
        if len(inner) > 1:
            import math

            slopes = {round(math.log(r.rate) / r.size, 6) for r in inner if r.size > 5}
            assert max(slopes) - min(slopes) < 1e-5
    again = M.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, (r.asDict().values() for r in again)), key=str) == sorted(map(tuple, (r.asDict().values() for r in got)), key=str)


def test_empty_and_wordless(spark):
    schema = "doc_id bigint, text string, source string"
    assert M.mix_sources(spark.createDataFrame([], schema)).count() == 0
    got = M.mix_sources(spark.createDataFrame([(1, None, None), (1, "", "a"), (2, " ", "a")], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    (r,) = M.mix_sources(spark.createDataFrame([(None, "a b c d", None)], schema)).collect()
    assert (r.size, r.target) == (4, 6.0) and r.taken in (4, 8)
