"""Tiny hand-made inputs of the goldens (FIXTURES.md, section D)."""

import numpy as np
from pyspark.sql import functions as F

from multitopic.plans.model import TopicModel
from multitopic.sources.corpus import Corpus

LAM0 = np.array([[4.5, 1.5, 0.5], [0.5, 2.5, 3.5]])
LAM1 = np.array([[3.5, 0.5], [1.5, 2.5]])
DOCS = {
    1: [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 3.0)],
    2: [(0, 2, 4.0)],
    3: [],
    4: [(0, 0, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 1, 2.0)],
}


def vocab(spark):
    rows = [(0, i, f"a{i}", 1, 1.0) for i in range(3)] + [(1, i, f"b{i}", 1, 1.0) for i in range(2)]
    return spark.createDataFrame(rows, "type_id INT, term_id INT, term STRING, doc_freq BIGINT, coll_freq DOUBLE")


def entries(spark, docs=DOCS):
    rows = [(d, t, w, c) for d, es in docs.items() for (t, w, c) in es]
    return spark.createDataFrame(rows, "doc_id BIGINT, type_id INT, term_id INT, cnt DOUBLE")


def docs_df(spark, ids=(1, 2, 3, 4)):
    return spark.createDataFrame([(int(i),) for i in ids], "doc_id BIGINT")


def state_from(spark, mats, eta=0.5, subtract_eta=True):
    rows = []
    for t, m in enumerate(mats):
        for w in range(m.shape[1]):
            s = [float(v - eta) if subtract_eta else float(v) for v in m[:, w]]
            rows.append((t, w, s, float(eta), float(eta)))
    return spark.createDataFrame(rows, "type_id INT, term_id INT, s ARRAY<DOUBLE>, eta0 DOUBLE, eta DOUBLE")


def g2_model(spark, **kw):
    corp = Corpus(entries(spark), vocab(spark), 2)
    return TopicModel.create(corp, k=2, alpha=0.5, eta=0.5, init="given", state=state_from(spark, [LAM0, LAM1]), **kw)


def by_doc(df, col="gamma"):
    return {r["doc_id"]: r for r in df.collect()}


def mats_from_state(state, num_terms, k=2, col="s"):
    out = [np.zeros((k, w)) for w in num_terms]
    for r in state.select("type_id", "term_id", col).collect():
        out[r["type_id"]][:, r["term_id"]] = r[col]
    return out


__all__ = ["F"]
