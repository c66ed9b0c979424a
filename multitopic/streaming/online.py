"""Mini-batch online learning from a Structured Streaming source (2.11).

Each micro-batch is one ``update()`` with ``passes = 1`` (documents
arriving in a stream); ``numdocs`` grows by the batch's documents. After
each batch the model is saved under ``model_path`` with the batch id, by one
atomic pointer swap (:mod:`..sources.model_io`). A restarted trainer goes on
from that model and skips a replayed batch that it already holds, so every
batch enters the model exactly once. Only a missing pointer means that
nothing was committed; a storage error is raised.

A trainer takes the documents of a micro-batch as they are: events of one
document that arrive in two batches would be two updates of the same document
id. :func:`closed_documents` in front of it (event time, watermark) hands on
every document once, when it is complete.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import corpus as C
from ..sources import model_io
from ..plans.train import update
from ..session import _fs_path, drop_path, materialize, source_path

log = logging.getLogger(__name__)


class StreamTrainer:
    """``foreachBatch`` sink training ``model`` with the terms that
    ``to_terms(batch_df)`` derives (``doc_id, type_id, term, cnt``)."""

    def __init__(self, model, to_terms: Callable[[DataFrame], DataFrame], model_path: str, **update_kw):
        self.model = model
        self.to_terms = to_terms
        self.path = model_path.rstrip("/")
        self.update_kw = {"passes": 1, "eval_every": 0, **update_kw}
        self.committed = model_io.committed_batch(model.spark, self.path)
        if self.committed >= 0:
            self.model = model_io.load(model.spark, self.path)
        self.dropped = 0
        self.own = False  # whether the model's state was written by this trainer

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.committed:
            return  # replayed batch: its update is already in the model
        # the batch's terms are read by several jobs (OOV count, sizes,
        # chunks, E step): written once instead of re-deriving from the source
        spark = self.model.spark
        terms = materialize(self.to_terms(batch), "stream-terms")
        vocab = self.model.vocab
        # the update works on a copy: the batch counts when its model is saved,
        # so a retry after a failure starts from the model before the batch
        model = self.model.with_params()
        before = source_path(self.model.state)
        try:
            unknown = C.oov_report(terms, vocab).count()
            entries = C.encode(terms, vocab, strict=False)
            if entries.limit(1).count():
                update(model, entries, **self.update_kw)
            model_io.save(model, self.path, batch_id=batch_id)
        except BaseException:
            if source_path(model.state) != before:
                drop_path(spark, source_path(model.state) or "")
            raise
        finally:
            drop_path(spark, source_path(terms) or "")
        if self.own and before and before != source_path(model.state):
            drop_path(spark, before)  # written by this trainer for an earlier batch
        self.own = self.own or before != source_path(model.state)
        self.model.adopt(model)
        self.dropped += unknown
        self.committed = batch_id


def train_stream(model, stream: DataFrame, to_terms, model_path: str, checkpoint: str, trigger_once: bool = True, **update_kw):
    """Start (and, with ``trigger_once``, drain) the training query; the
    trained model is ``sink.model`` (the committed one after a restart)."""
    sink = StreamTrainer(model, to_terms, model_path, **update_kw)
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    q = w.start()
    if trigger_once:
        q.awaitTermination()
    return sink, q


def events_stream(spark, events_path: str, max_files: int = 1) -> DataFrame:
    """Events as a stream (file source); ``ts`` is cast to TIMESTAMP (the
    files hold TIMESTAMP_NTZ, which watermarks refuse)."""
    schema = spark.read.parquet(events_path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    fs, p = _fs_path(spark, events_path)
    if not fs.getFileStatus(p).isDirectory():
        # a single file: stream its folder, restricted to that file name
        folder, name = events_path.rsplit("/", 1)
        s = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        s = reader.parquet(events_path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def user_day_terms(batch: DataFrame) -> DataFrame:
    return C.user_days(batch)


def score_stream(model, stream: DataFrame, to_terms, sink_path: str, checkpoint: str, trigger_once: bool = True,
                 minimum_probability: float | None = None):
    """Streaming scoring (stream-static): every micro-batch of documents is
    scored with the fixed model and appended as ``(doc_id, topic, p,
    batch_id)`` Parquet rows; unknown terms are dropped and reported (D12):
    they are logged and written under ``<sink_path>_unknown/batch_id=...``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        terms = materialize(to_terms(batch), "stream-terms")
        unknown = f"{sink_path.rstrip('/')}_unknown/batch_id={batch_id}"
        C.oov_report(terms, model.vocab).write.mode("overwrite").parquet(unknown)
        n = model.spark.read.parquet(unknown).count()
        if n:
            log.warning("batch %d: %d unknown terms dropped, listed in %s", batch_id, n, unknown)
        entries = C.encode(terms, model.vocab, strict=False)
        out = model.document_topics(entries, minimum_probability).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        # overwrite of this batch's own partition keeps a replayed batch exactly-once
        out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch_id={batch_id}")
        drop_path(model.spark, source_path(terms) or "")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    q = w.start()
    if trigger_once:
        q.awaitTermination()
    return q


def score_nested(model, docs: DataFrame, minimum_probability: float | None = None) -> DataFrame:
    """``(doc_id, topic, p)`` of documents that are nested already, ``(doc_id,
    bag ARRAY<STRUCT<type_id, term_id, cnt>>)``: one stateless kernel stage, for
    a table or a stream (which can be appended to any sink). The topic vectors
    are broadcast, so their size is checked."""
    from ..operators import estep as E

    p = model.params
    least = max(p.minimum_probability if minimum_probability is None else minimum_probability, 1e-8)
    fn = E.make_kernel("gamma", model.alpha, model.num_types, p.iterations, p.gamma_threshold, p.epsilon, model.eb_broadcast(), model.type_offsets())
    if model.gamma_draws() is not None:
        docs = docs.withColumn("gamma0", model.gamma_draws())
    theta = F.expr("transform(vec, x -> x / aggregate(vec, 0D, (a, y) -> a + y))")
    return E.run(docs, fn).select("doc_id", F.posexplode(theta).alias("topic", "p")).where(F.col("p") >= least)


def closed_documents(terms: DataFrame, watermark: str, window: str | None = "1 day", gap: str | None = None) -> DataFrame:
    """Documents of an unbounded stream, each emitted once and whole.

    ``terms`` streams ``(ts, key, type_id, term, cnt)``. A document is all that
    a key has in one ``window`` of event time, or, with ``gap``, until nothing
    came for that long. Its counts stay in the state until the watermark says
    that no more of it can come; then all its rows ``(start, key, type_id, term,
    cnt)`` leave in the same micro-batch and the state forgets them. So a
    trainer behind this operator never sees half a document, however the
    source's files or offsets cut it. Rows later than the watermark are dropped
    by it, as everywhere in Structured Streaming."""
    return _closed(terms.withWatermark("ts", watermark), window, gap)


def _closed(late: DataFrame, window: str | None = "1 day", gap: str | None = None) -> DataFrame:
    """The same behind a watermark on ``ts`` that is set already."""
    if gap is None:
        rows = late.groupBy(F.window("ts", window).alias("_w"), "key", "type_id", "term").agg(F.sum("cnt").alias("cnt"))
    else:
        # sessions are the document's, so its terms stay together in one state row
        docs = late.groupBy(F.session_window("ts", gap).alias("_w"), "key").agg(F.collect_list(F.struct("type_id", "term", "cnt")).alias("_e"))
        rows = docs.select("_w", "key", F.explode("_e").alias("_e")).select("_w", "key", "_e.*")
    return rows.select(F.col("_w.start").alias("start"), "key", "type_id", "term", F.col("cnt").cast("double").alias("cnt"))


def sum_terms(batch: DataFrame) -> DataFrame:
    """One row per (document, term) of a micro-batch of closed documents."""
    return batch.groupBy("doc_id", "type_id", "term").agg(F.sum("cnt").alias("cnt"))


def closed_user_days(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """User-day documents ``(doc_id, type_id, term, cnt)`` of an event stream,
    each emitted once its day is over: what feeds :func:`train_stream` from an
    unbounded stream. Input ``ts`` must be TIMESTAMP."""
    bucket = F.concat(F.lit("v"), F.floor(F.col("value") / 100).cast("bigint").cast("string"))
    items = F.array(F.struct(F.lit(0).alias("t"), F.col("event_type").alias("w")), F.struct(F.lit(1).alias("t"), bucket.alias("w")))
    # the watermark stands before the filter: rows without terms move it too
    ev = events.withWatermark("ts", watermark).select("ts", F.col("user_id").alias("key"), F.explode(items).alias("x"))
    terms = ev.where(F.col("x.w").isNotNull()).select("ts", "key", F.col("x.t").alias("type_id"), F.col("x.w").alias("term"), F.lit(1.0).alias("cnt"))
    day = F.datediff(F.to_date("start"), F.lit("1970-01-01").cast("date"))
    return _closed(terms).select((F.col("key") * F.lit(100000) + day).cast("bigint").alias("doc_id"), F.col("type_id").cast("int"), "term", "cnt")
