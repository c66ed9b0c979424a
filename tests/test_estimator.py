"""The estimator form equals the function form, alone and inside a Pipeline."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from multitopic.plans.estimator import TopicEstimator, TopicEstimatorModel
from multitopic.plans.model import TopicModel
from multitopic.plans.train import update
from multitopic.session import scratch_path
from multitopic.sources import corpus as C

KW = {"k": 3, "init": "assign", "iterations": 10, "chunkSize": 20, "passes": 1}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, [(j % 2, f"t{(d * 5 + j * j) % 13}", 1.0 + j % 2) for j in range(3 + d % 5)]) for d in range(50)]
    data += [(90, []), (91, None), (92, [(0, "never seen", 1.0)]), (None, [(0, "t1", 1.0)])]
    return spark.createDataFrame(data, "doc_id BIGINT, terms ARRAY<STRUCT<type_id: INT, term: STRING, cnt: DOUBLE>>").withColumn("own", F.lit("x"))


def test_pipeline_fits_transforms_and_survives_saving(spark, rows):
    seen = rows.where("doc_id < 50")
    stages = [SQLTransformer(statement="SELECT *, 1 AS extra FROM __THIS__"), TopicEstimator(**KW)]
    fitted = Pipeline(stages=stages).fit(seen)
    got = {r.doc_id: r for r in fitted.transform(rows).collect()}
    terms = seen.select("doc_id", F.explode("terms").alias("e")).select("doc_id", "e.*").groupBy("doc_id", "type_id", "term").agg(F.sum("cnt").alias("cnt"))
    vocab = C.vocabulary(terms)
    corpus = C.Corpus(C.encode(terms, vocab), vocab, 2)
    m = TopicModel.create(corpus, k=3, init="assign", iterations=10, chunksize=20)
    update(m, corpus.entries, eval_every=0)
    want = {r.doc_id: r.theta for r in m.transform(corpus.entries).collect()}
    assert len(got) == rows.count() and all(np.abs(np.array(got[d].topics) - want[d]).max() < 1e-9 for d in want)
    for d in (90, 91, 92, None):
        assert np.allclose(got[d].topics, 1 / 3)
    assert got[0].own == "x" and got[0].extra == 1
    path = scratch_path(spark, "t-pipeline")
    fitted.write().save(path)
    again = PipelineModel.load(path)
    back = {r.doc_id: r.topics for r in again.transform(rows).collect()}
    assert back.keys() == got.keys() and all(np.abs(np.array(back[d]) - got[d].topics).max() < 1e-12 for d in got)
    assert isinstance(again.stages[1], TopicEstimatorModel) and again.stages[1].value("k") == 3


def test_estimator_parameters_survive_saving(spark):
    path = scratch_path(spark, "t-estimator")
    e = TopicEstimator(k=7, decay=0.7, topicsCol="mix")
    e.write().save(path)
    f = TopicEstimator.load(path)
    assert (f.value("k"), f.value("decay"), f.value("topicsCol"), f.value("passes"), f.uid) == (7, 0.7, "mix", 1, e.uid)
    with pytest.raises(ValueError):
        TopicEstimator(topics=3)


def test_arrays_of_words(spark):
    docs = spark.createDataFrame([(k, [f"w{(k + j) % 5}" for j in range(4)] + [None]) for k in range(20)], "doc_id BIGINT, terms ARRAY<STRING>")
    out = TopicEstimator(k=2, init="assign", iterations=5).fit(docs).transform(docs).collect()
    assert len(out) == 20 and all(abs(sum(r.topics) - 1) < 1e-9 for r in out)
