import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from multitopic.llm import quality_rules as Q

from . import messy

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(SPACE, text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] >= 2 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    plain = r"[A-Za-z'\-\u0080-\U0010ffff]+[.,;:!?]?"
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=len(covered), n_letter_words=sum(bool(re.search(r"[A-Za-z\u0080-\U0010ffff]", x)) for x in w),
        n_plain_words=sum(bool(re.fullmatch(plain, x)) for x in w), n_letters=len(re.findall(r"[A-Za-z]", text)), n_capitals=len(re.findall(r"[A-Z]", text)),
        n_marks=len(re.findall(r"[!-/:-@\[-`{-~]", text)), n_lines=len(lines),
    )


def texts():
    rng = random.Random(3)
    prose = lambda n: " ".join("Abc def, ghij klmno. Pq rst".split()[rng.randrange(6)] + rng.choice("aeiou") for _ in range(n))
    line = prose(9)
    out = [None, "", " \n ", "x", "Été été ÉTÉ — «ok».", "a\n\na\n a\nb\r\nb\n", "same " * 40, "\n".join([line] * 12), "Case case Case " * 8]
    out += [prose(n) for n in (5, 19, 20, 21, 60, 300)]
    out += [" ".join(x + "***" for x in prose(80).split()), prose(120).upper() + "!!", " | ".join(prose(70).split()), "12 34 56 " * 30]
    out += [line + "\n" + prose(40) + "\n" + line, prose(4000), "<b>" * 200 + " x" * 30]
    return out


def test_counts_match_brute_force(spark):
    rows = [(k, t) for k, t in enumerate([*texts(), *[t for _, t in messy.documents()]])]
    got = {r.doc_id: r.asDict() for r in Q.count_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        got[k].pop("doc_id")
        assert got[k] == brute(t), t


def test_estimate_matches_plain_em():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.6
    accuracy, casts = [0.95, 0.8, 0.7, 0.55], [0.9, 0.7, 0.8, 0.5]
    votes = np.zeros((4000, 4), dtype=int)
    for j, (a, c) in enumerate(zip(accuracy, casts, strict=True)):
        right = rng.random(4000) < a
        votes[:, j] = np.where(rng.random(4000) < c, np.where(right == truth, 1, -1), 0)
    patterns, rows = np.unique(votes, axis=0, return_counts=True)
    model = Q.estimate(patterns, rows.astype(float))
    acc = [Q.START] * 4
    for _ in range(Q.ROUNDS):
        right, cast = [Q.START * Q.PRIOR] * 4, [Q.PRIOR] * 4
        for v in votes.tolist():
            good, bad = 1.0, 1.0
            for x, a in zip(v, acc, strict=True):
                good *= a if x > 0 else 1 - a if x < 0 else 1
                bad *= 1 - a if x > 0 else a if x < 0 else 1
            p = good / (good + bad)
            for j, x in enumerate(v):
                right[j] += p if x > 0 else 1 - p if x < 0 else 0
                cast[j] += x != 0
        acc = [max(0.5, r / c) for r, c in zip(right, cast, strict=True)]
    assert np.allclose(model.accuracy, acc, atol=1e-9)
    assert all(abs(a - b) < 0.06 for a, b in zip(model.accuracy, accuracy, strict=True))


def test_verdicts(spark):
    rows = [(k, t) for k, t in enumerate(texts() * 3)]
    docs = messy.frame(spark, rows)
    scored = {r.doc_id: r for r in Q.score_quality(docs.select("doc_id", "text")).collect()}
    model = Q.fit(Q.count_rows(docs.select("doc_id", "text")))
    for k, t in rows:
        c = brute(t)
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        assert scored[k].base_failed == failed
        one = duckdb.sql("SELECT " + ", ".join(Q.vote(r) for r in Q.RULES) + " FROM (SELECT " + ", ".join(f"{v} AS {n}" for n, v in c.items()) + ")").fetchall()[0]
        odds = sum(v * math.log(a / (1 - a)) for v, a in zip(one, model.accuracy, strict=True))
        assert scored[k].p_good == pytest.approx(1 / (1 + math.exp(-odds)), abs=2e-6)
        assert scored[k].kept == (not failed and scored[k].p_good >= Q.KEEP)
        if t and t.endswith("***"):
            assert not scored[k].kept
    kept = Q.keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in scored.items() if r.kept)
    assert {r.score for r in kept.collect()} == {"own score"}


def test_ids_do_not_matter(spark):
    """Null, shared and repeated ids: one row for each row, each by its own text."""
    rows = [(None, "x"), (None, "word " * 30), (1, "ab cd"), (1, None), (1, "ab cd"), (2, "Ein Satz, der gut ist. " * 2)]
    got = sorted((str(r.doc_id), r.n_words) for r in Q.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted((str(i), len((t or "").split())) for i, t in rows)


def test_empty_table(spark):
    assert Q.score_quality(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_oracle_equals_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts() * 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in Q.op11_quality_rules(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(Q.ORACLE).fetchall())


def test_labels_are_met(spark):
    """On the labelled rows of the small table the verdict is nearly the label
    (texts under 20 words and repeats fail by the base rule alone)."""
    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    got = Q.op11_quality_rules(spark, root).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in got]) > 0.97
