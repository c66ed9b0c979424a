import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from multitopic.llm import toxicity_fm as T
from multitopic.llm.text import slices

from . import messy


def corpus(n=1500, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = messy.sentence(rng, rng.randrange(5, 200 if k % 50 else 3000), 500)
        y = rng.random() < 0.2
        if y:
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(["vilewort", "nastyoid", "grrr" + rng.choice("abcdefgh") * 3])
        rows.append((k, " ".join(w)))
        labels.append((k, rng.randrange(2), int(y)))
    return rows, labels


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus()
    rows += [(5000, None), (5001, ""), (None, "vilewort nastyoid"), (3, rows[3][1])]
    marks = spark.createDataFrame([*labels, (9999, 0, 1), (None, 0, 1), (4, 0, None)], "doc_id bigint, quality int, toxic int")
    got = T.toxicity(messy.frame(spark, rows), marks).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for y, p in held if y]) > 0.9 and np.mean([p for y, p in held if not y]) < 0.02
    again = {r.doc_id: r.score for r in T.toxicity(messy.frame(spark, rows).repartition(2), marks).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)


def test_pairs_count_beyond_their_parts():
    rng = np.random.default_rng(0)
    sets, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4
        noise = rng.integers(100, 1 << T.BITS, 20)
        sets.append(np.unique(np.concatenate([[7] * int(a), [9] * int(b), noise])).astype(np.int64))
        label.append(float(a and b))
    m = T.fit(sets, np.array(label), l1=1.0)
    z = lambda *c: T._margins(np.zeros(len(c), int), m.weight[list(c)], m.factor[list(c)], 1, m.bias)[0][0]
    assert z(7, 9) > 1 > -1 > max(z(7), z(9))
    assert m.factor[7] @ m.factor[9] > 0.2


def test_nothing_to_learn_from(spark):
    docs = messy.frame(spark, messy.documents())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in T.toxicity(docs, none).collect()} == {0}
    assert T.toxicity(docs.where("false"), none).count() == 0
    kept = T.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.score for r in kept.collect()} == {"own score"}


def test_only_rows_that_do_not_fit_are_passed_over(spark):
    assert T.SAMPLE_ROWS >= 16_000
    for codes in ([], [0], [254, 255, 256], [T.BITS, (1 << T.BITS) - 1], range(1 << T.BITS)):
        (back,) = T.Packed(pa.chunked_array([pa.array([T.pack(np.array(codes, dtype=np.int64))], pa.binary())]))
        assert back.tolist() == list(codes)
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [r.doc_id for r in marks.where(T.fold("doc_id") != 1).orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    long = " ".join(f"q{k}" for k in range(100_000))
    first = docs.withColumn("text", F.when(F.col("doc_id") == order[0], F.lit(long)).otherwise(F.col("text")))
    (part,) = slices(pa.array([long]))
    size = len(T.pack(np.unique(np.concatenate(T.term_codes(part)[0]))))
    a = T.train(first, marks)
    b = T.train(first, marks, sample_bytes=size - 1)  # all but the first id
    assert not np.array_equal(a.weight, b.weight)
    c = T.train(docs.where(F.col("doc_id") != order[0]), marks, sample_bytes=size - 1)
    assert np.array_equal(b.weight, c.weight) and b.bias == c.bias != T.fit([], np.zeros(0)).bias
