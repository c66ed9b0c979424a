"""The model as a Spark ML estimator (M1, S9, S10): parameters, ``fit``,
``transform`` and persistence inside a ``Pipeline``.

The input has a column of documents, each an array of ``(type_id, term,
cnt)`` structs (several kinds of terms at once) or an array of strings (one
kind, counted). ``fit`` builds the vocabulary, trains the online model and
returns a :class:`TopicEstimatorModel`; ``transform`` adds each row's topic
mixture as an array. Rows are told apart by ``docIdCol`` (one row per id); a row
whose terms are all unknown, empty or null gets the prior mixture.

Only thin plumbing lives here: training, inference, saving and loading are those
of :class:`~multitopic.plans.model.TopicModel` and :mod:`~multitopic.sources.model_io`.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path, materialize, source_path
from ..sources import corpus as C
from ..sources import model_io
from .model import TopicModel
from .train import update

#: the estimator's defaults, by parameter
DEFAULTS = {
    "docIdCol": "doc_id", "termsCol": "terms", "topicsCol": "topics", "k": 100, "chunkSize": 2000, "passes": 1, "updateEvery": 1,
    "decay": 0.5, "offset": 1.0, "iterations": 50, "gammaThreshold": 0.001, "alpha": "symmetric", "eta": "symmetric", "init": "random", "seed": 0,
}


class _TopicParams(Params):
    docIdCol = Param(Params._dummy(), "docIdCol", "column of the document id (bigint)", TypeConverters.toString)
    termsCol = Param(Params._dummy(), "termsCol", "column of the document's terms", TypeConverters.toString)
    topicsCol = Param(Params._dummy(), "topicsCol", "column of the topic mixture", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of topics", TypeConverters.toInt)
    chunkSize = Param(Params._dummy(), "chunkSize", "documents per chunk", TypeConverters.toInt)
    passes = Param(Params._dummy(), "passes", "passes over the documents", TypeConverters.toInt)
    updateEvery = Param(Params._dummy(), "updateEvery", "chunks per update, 0: all", TypeConverters.toInt)
    decay = Param(Params._dummy(), "decay", "exponent of the learning rate", TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "offset of the learning rate", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "rounds of inference at most", TypeConverters.toInt)
    gammaThreshold = Param(Params._dummy(), "gammaThreshold", "change that ends inference", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "document prior: symmetric, asymmetric or auto", TypeConverters.toString)
    eta = Param(Params._dummy(), "eta", "term prior: symmetric or auto", TypeConverters.toString)
    init = Param(Params._dummy(), "init", "start: random or assign", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the random start", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(**DEFAULTS)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def corpus_terms(self, rows: DataFrame) -> DataFrame:
        """Long form ``(doc_id, type_id, term, cnt)`` of the terms column."""
        item = rows.schema[self.value("termsCol")].dataType.elementType
        long = rows.select(F.col(self.value("docIdCol")).cast("bigint").alias("doc_id"), F.explode(self.value("termsCol")).alias("e"))
        if isinstance(item, T.StructType):
            long = long.select("doc_id", F.col("e.type_id").cast("int").alias("type_id"), F.col("e.term").cast("string").alias("term"), F.col("e.cnt").cast("double").alias("cnt"))
        else:
            long = long.select("doc_id", F.lit(0).alias("type_id"), F.col("e").cast("string").alias("term"), F.lit(1.0).alias("cnt"))
        return long.where("term IS NOT NULL AND cnt > 0").groupBy("doc_id", "type_id", "term").agg(F.sum("cnt").alias("cnt"))


class TopicEstimator(Estimator, _TopicParams, DefaultParamsReadable, DefaultParamsWritable):
    """Online training of the multi-type topic model."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self.setParams(**kwargs)

    @keyword_only
    def setParams(self, **kwargs):
        given = self._input_kwargs if hasattr(self, "_input_kwargs") else kwargs
        unknown = set(given) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        return self._set(**given)

    def _fit(self, dataset: DataFrame) -> "TopicEstimatorModel":
        terms = materialize(self.corpus_terms(dataset), "ml-terms")
        vocab = materialize(C.vocabulary(terms), "ml-vocab")
        types = (terms.agg(F.max("type_id")).first()[0] or 0) + 1
        entries = materialize(C.encode(terms, vocab, strict=False), "ml-entries")
        names = {"iterations": "iterations", "gammaThreshold": "gamma_threshold", "chunkSize": "chunksize", "passes": "passes", "updateEvery": "update_every", "decay": "decay", "offset": "offset", "seed": "seed"}
        model = TopicModel.create(
            C.Corpus(entries, vocab, types), k=self.value("k"), alpha=self.value("alpha"), eta=self.value("eta"), init=self.value("init"),
            **{theirs: self.value(ours) for ours, theirs in names.items()},
        )
        update(model, entries, eval_every=0)
        for table in (terms, entries):
            drop_path(dataset.sparkSession, source_path(table) or "")
        return self._copyValues(TopicEstimatorModel(model))


class TopicEstimatorModel(Model, _TopicParams, MLReadable, MLWritable):
    """A trained model; ``topic_model`` is the library's own form of it."""

    def __init__(self, topic_model: TopicModel | None = None):
        super().__init__()
        self.topic_model = topic_model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m, key = self.topic_model, self.value("docIdCol")
        terms = self.corpus_terms(dataset)
        entries = C.encode(terms, m.vocab, strict=False)
        docs = dataset.select(F.col(key).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        theta = m.transform(entries, docs).select(F.col("doc_id").alias("_doc"), F.col("theta").alias(self.value("topicsCol")))
        prior = F.array(*[F.lit(float(a) / float(m.alpha.sum())) for a in m.alpha])
        out = dataset.join(theta, dataset[key].cast("bigint") == theta["_doc"], "left").drop("_doc")
        return out.withColumn(self.value("topicsCol"), F.coalesce(self.value("topicsCol"), prior))

    def write(self) -> "_ModelWriter":
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> "_ModelReader":
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: TopicEstimatorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        model_io.save(self.instance.topic_model, f"{path.rstrip('/')}/model")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TopicEstimatorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(model_io.load(self.sparkSession, f"{path.rstrip('/')}/model"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
