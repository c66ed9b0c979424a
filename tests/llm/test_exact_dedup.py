import hashlib
from collections import Counter, defaultdict

import pytest

from multitopic.llm import exact_dedup as D

from . import messy


@pytest.mark.parametrize("min_share", [1e-3, 0.02, 1.0])
def test_groups_match_brute_force(spark, min_share):
    rows = messy.documents() + [(1000 + k, "copy") for k in range(40)] + [(5000, None), (5001, "")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    got = {r[0]: tuple(r[1:]) for r in D.exact_dedup(messy.frame(spark, rows), min_share=min_share).collect()}
    assert got == want


@pytest.mark.parametrize("min_share", [0.0, 1.0])
def test_repeats_nulls_and_own_columns(spark, min_share):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "b"), (3, None), (None, "only"), (None, "only")]
    df = messy.frame(spark, rows)
    marked = D.exact_dedup(df, min_share=min_share).collect()
    assert len(marked) == len(rows)
    assert Counter((r.keep_id, r.group_size) for r in marked if r.kept) == Counter([(1, 3), (2, 3), (3, 1), (None, 2)])
    kept = D.keep_first_copies(df, min_share=min_share)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text), r.keep_id, r.text_sha256) for r in kept.collect()) == sorted(
        (i, t, "own keep_id", "own text_sha256") for i, t in (("1", "a"), ("2", "b"), ("3", "None"), ("None", "only"))
    )


def test_heavy_groups_are_bounded_and_exact(spark):
    df = D.with_digest(spark.createDataFrame([(k, f"t{k % 10}" if k < 200 else f"u{k}") for k in range(400)], "doc_id bigint, text string"))
    heavy = D.heavy_digests(df.select("doc_id", "text_sha256"), "doc_id", top=5, tracked=1024, min_share=0.04).collect()
    assert len(heavy) == 5 and all(r._n == 20 and 190 <= r._keep < 200 for r in heavy)


def test_empty_table(spark):
    assert D.exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
