"""Streaming = batch; a replayed batch id does not update twice."""

import numpy as np
from pyspark.sql import functions as F

from multitopic.plans.model import TopicModel
from multitopic.plans.train import update
from multitopic.session import scratch_path
from multitopic.sources import corpus as C
from multitopic.streaming.online import StreamTrainer, events_stream, train_stream, user_day_terms

SF = "/root/testdata/sf0.001"


def _model(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    terms = C.user_days(ev)
    vocab = C.vocabulary(terms)
    return ev, C.Corpus(C.encode(terms, vocab, strict=False), vocab, 2)


def test_stream_equals_batch_and_replay_is_noop(spark):
    ev, corp = _model(spark)
    m_stream = TopicModel.create(corp, k=3, init="assign", iterations=5)
    m_batch = TopicModel.create(corp, k=3, init="assign", iterations=5)
    sink, _ = train_stream(m_stream, events_stream(spark, f"{SF}/events.parquet"), user_day_terms,
                           scratch_path(spark, "t-model"), scratch_path(spark, "t-ckpt"), update_every=0)
    update(m_batch, corp.entries, passes=1, update_every=0, eval_every=0)
    a = {(r.type_id, r.term_id): r.s for r in m_stream.state.collect()}
    b = {(r.type_id, r.term_id): r.s for r in m_batch.state.collect()}
    assert a.keys() == b.keys()
    assert max(np.abs(np.array(a[k]) - np.array(b[k])).max() for k in a) < 1e-9
    before = m_stream.version
    sink(ev, 0)  # batch 0 again: already committed
    assert m_stream.version == before and m_stream.numdocs == m_batch.numdocs


def test_stream_scoring_and_closed_days(spark):
    from multitopic.streaming.online import closed_user_days, score_stream

    ev, corp = _model(spark)
    m = TopicModel.create(corp, k=3, init="assign", iterations=5)
    out = scratch_path(spark, "t-scores")
    score_stream(m, events_stream(spark, f"{SF}/events.parquet"), user_day_terms, out, scratch_path(spark, "t-ckpt2"))
    got = spark.read.parquet(out)
    assert got.select("doc_id").distinct().count() == corp.entries.select("doc_id").distinct().count()

    q = (closed_user_days(events_stream(spark, f"{SF}/events.parquet")).writeStream.outputMode("append")
         .format("memory").queryName("closed_days").trigger(availableNow=True)
         .option("checkpointLocation", scratch_path(spark, "t-ckpt3")).start())
    q.awaitTermination()
    emitted = {(r.doc_id, r.type_id, r.term): r.cnt for r in spark.sql("SELECT * FROM closed_days").collect()}
    batch = {(r.doc_id, r.type_id, r.term): r.cnt for r in C.user_days(ev).collect()}
    assert emitted and all(batch[k] == v for k, v in emitted.items())  # emitted days are complete


def _stream_folder(spark, parts):
    path = scratch_path(spark, "t-events")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    return path


def test_training_sees_every_closed_document_once(spark):
    """Files cut days in two; the documents that train are whole all the same."""
    from multitopic.streaming.online import closed_user_days, sum_terms

    ev, corp = _model(spark)
    cut = ev.select(F.col("ts").cast("double").alias("s")).approxQuantile("s", [0.4, 0.7], 0.0)
    s = F.col("ts").cast("double")
    flush = ev.limit(1).select(*[(F.lit("2100-01-01").cast("timestamp") if c == "ts" else F.lit(None).cast(ev.schema[c].dataType)).alias(c) for c in ev.columns])
    src = _stream_folder(spark, [ev.where(s <= cut[0]), ev.where((s > cut[0]) & (s <= cut[1])), ev.where(s > cut[1]), flush])
    seen = []

    def keep(batch):
        seen.extend((r.doc_id, r.type_id, r.term, r.cnt) for r in batch.collect())
        return sum_terms(batch)

    m = TopicModel.create(corp, k=3, init="assign", iterations=3)
    sink, _ = train_stream(m, closed_user_days(events_stream(spark, src)), keep, scratch_path(spark, "t-model"), scratch_path(spark, "t-ckpt"), update_every=0)
    assert sorted(seen) == sorted((r.doc_id, r.type_id, r.term, r.cnt) for r in C.user_days(ev).collect())
    assert sink.model.numdocs == corp.entries.select("doc_id").distinct().count()
    assert sink.committed >= 1


def test_sessions_close_after_a_gap(spark):
    from multitopic.streaming.online import closed_documents, sum_terms

    rows = [(f"2024-01-01 00:{m:02d}:00", k, 0, t, 1.0) for k, m, t in ((1, 0, "a"), (1, 5, "a"), (1, 9, "b"), (1, 40, "c"), (2, 3, "a"), (2, 30, "a"))]
    rows.append(("2024-01-02 00:00:00", 9, 0, "z", 1.0))
    df = spark.createDataFrame(rows, "ts STRING, key BIGINT, type_id INT, term STRING, cnt DOUBLE").withColumn("ts", F.col("ts").cast("timestamp"))
    src = _stream_folder(spark, [df.where(F.minute("ts") < 6).where("key < 9"), df.where(F.minute("ts") >= 6), df.where("key = 9")])
    closed = closed_documents(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), "1 minute", gap="10 minutes")
    q = closed.writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "t-ckpt")).start()
    q.awaitTermination()
    start = F.minute("start").cast("bigint")
    got = sum_terms(spark.table("sessions").withColumn("doc_id", F.col("key") * 100 + start)).where("doc_id < 900").collect()
    assert sorted((r.doc_id, r.term, r.cnt) for r in got) == [(100, "a", 2.0), (100, "b", 1.0), (140, "c", 1.0), (203, "a", 1.0), (230, "a", 1.0)]


def test_failed_save_applies_nothing_twice(spark, monkeypatch):
    from multitopic.streaming import online

    ev, corp = _model(spark)
    m = TopicModel.create(corp, k=3, init="assign", iterations=3)
    once = TopicModel.create(corp, k=3, init="assign", iterations=3)
    sink = StreamTrainer(m, user_day_terms, scratch_path(spark, "t-model"), update_every=0)
    save = online.model_io.save
    monkeypatch.setattr(online.model_io, "save", lambda *a, **k: (_ for _ in ()).throw(OSError("storage away")))
    before = {(r.type_id, r.term_id): r.s for r in m.state.collect()}
    try:
        sink(ev, 0)
        raise AssertionError("the storage error was lost")
    except OSError:
        pass
    assert {(r.type_id, r.term_id): r.s for r in m.state.collect()} == before and m.numdocs == 0 and sink.committed == -1
    monkeypatch.setattr(online.model_io, "save", save)
    sink(ev, 0)
    update(once, corp.entries, passes=1, update_every=0, eval_every=0)
    a, b = ({(r.type_id, r.term_id): r.s for r in x.state.collect()} for x in (m, once))
    assert max(np.abs(np.array(a[k]) - np.array(b[k])).max() for k in a) < 1e-9 and m.numdocs == once.numdocs
    sink(ev.where("user_id % 2 = 0"), 1)  # goes on from the committed model
    assert m.version == 2 and m.numdocs > once.numdocs


def test_nested_stream_needs_no_shuffle(spark):
    import contextlib
    import io

    from multitopic.operators.estep import nest
    from multitopic.session import materialize, source_path
    from multitopic.streaming.online import score_nested

    _, corp = _model(spark)
    m = TopicModel.create(corp, k=3, init="assign", iterations=5)
    nested = materialize(nest(corp.entries).repartition(2, "doc_id"), "t-docs")
    stream = score_nested(m, spark.readStream.schema(nested.schema).parquet(source_path(nested)))
    assert stream.isStreaming
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        stream.explain()
    assert "MapInArrow" in out.getvalue() and "Exchange" not in out.getvalue()
    q = stream.writeStream.outputMode("append").format("memory").queryName("scores").trigger(availableNow=True).option("checkpointLocation", scratch_path(spark, "t-ckpt")).start()
    q.awaitTermination()
    got = {(r.doc_id, r.topic): r.p for r in spark.table("scores").collect()}
    want = {(r.doc_id, r.topic): r.p for r in m.document_topics(corp.entries).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
