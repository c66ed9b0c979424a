"""Benchmark of the headline operators.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Steps (each forced with a no-op write, i.e. full execution, no collect;
a five-row query warms the fresh JVM first, untimed):
  corpus_build      purchases corpus + vocabulary + encoding (joins, aggregations)
  text_corpus       whole-text tokenisation of `documents` + vocabulary
  estep_broadcast   E step, K=20, all customers (topic table broadcast)
  estep_join        E step, K=20, text corpus, topic table joined (large vocabulary)
  train_online      online training, K=20, chunks of 2000 customers, 1 pass (M steps)
  score_docs        document topics (transform + threshold)
  bound             variational bound / perplexity
  topic_diff        KL + Hellinger + JS + Jaccard + rescaled dot, K=20 x K=20
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
K = int(os.environ.get("BENCH_K", "20"))


def sf_of(path: str) -> str:
    base = os.path.basename(path)
    return base[2:] if base.startswith("sf") else base


def force(df):
    df.write.format("noop").mode("overwrite").save()


def scratch_tables(spark) -> set[str]:
    """Folders below <spark.checkpoint.dir>/multitopic (tables this library wrote)."""
    from multitopic.session import ensure_checkpoint_dir

    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark).rstrip("/") + "/multitopic")
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return {st.getPath().toString() for st in fs.listStatus(p)} if fs.exists(p) else set()


def main():
    from multitopic.session import local_session, materialize
    from multitopic.sources import corpus as C
    from multitopic.plans.model import TopicModel
    from multitopic.plans.train import update
    from multitopic.plans.evaluate import bound
    from multitopic.operators.compare import diff

    spark = local_session(CPUS, shuffle_partitions=int(CPUS) * 2, app="multitopic-bench")
    times: dict[str, float] = {}
    extra: dict[str, float] = {}
    before = scratch_tables(spark)
    # untimed warm-up of the fresh JVM (class loading, Parquet reader, codegen)
    spark.read.parquet(f"{SF_DIR}/region.parquet").groupBy("r_regionkey").count().collect()

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    def build():
        terms = materialize(C.purchases(spark, SF_DIR), "b-terms")
        vocab = materialize(C.vocabulary(terms), "b-vocab")
        entries = materialize(C.encode(terms, vocab, strict=False), "b-entries")
        return C.Corpus(entries, vocab, 3)

    corp = timed("corpus_build", build)

    def build_text():
        terms = materialize(C.texts(spark, SF_DIR), "b-text")
        vocab = materialize(C.vocabulary(terms), "b-tvocab")
        entries = materialize(C.encode(terms, vocab, strict=False), "b-tentries")
        return C.Corpus(entries, vocab, 3)

    text = timed("text_corpus", build_text)

    model = TopicModel.create(corp, k=K, init="assign")
    n_docs = corp.entries.select("doc_id").distinct().count()
    n_tokens = corp.entries.agg({"cnt": "sum"}).collect()[0][0]
    model.exp_elogbeta().count()

    prep = model.prepare(corp.entries)
    timed("estep_broadcast", lambda: force(model.rows(prep, "gamma")))
    extra["estep_docs_per_sec"] = round(n_docs / max(times["estep_broadcast"], 1e-9), 1)
    extra["estep_tokens_per_sec"] = round(n_tokens / max(times["estep_broadcast"], 1e-9), 1)

    tmodel = TopicModel.create(text, k=K, init="assign", strategy="join")
    tmodel.exp_elogbeta().count()
    tprep = tmodel.prepare(text.entries)
    timed("estep_join", lambda: force(tmodel.rows(tprep, "gamma")))

    m2 = TopicModel.create(corp, k=K, init="random", seed=3)
    t0 = time.time()
    timed("train_online", lambda: update(m2, corp.entries, chunksize=2000, passes=1, update_every=1, eval_every=0))
    n_msteps = len([m for m in m2.metrics if m["metric"] == "rho"])
    extra["sec_per_mstep"] = round(times["train_online"] / max(1, n_msteps), 3)

    timed("score_docs", lambda: force(m2.document_topics(corp.entries)))
    extra["score_docs_per_sec"] = round(n_docs / max(times["score_docs"], 1e-9), 1)

    timed("bound", lambda: bound(m2, corp.entries))

    def diffs():
        for d in ("kullback_leibler", "hellinger", "jensen_shannon", "jaccard", "rescale_dot"):
            force(diff(model, m2, d, annotation=(d == "hellinger")))

    timed("topic_diff", diffs)

    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_sec",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf_of(SF_DIR),
                "k": K,
                "cpus": CPUS,
                "docs": n_docs,
                "tokens": n_tokens,
                **extra,
            }
        )
    )
    from multitopic.session import drop_path

    for path in scratch_tables(spark) - before:  # this run's intermediate tables
        drop_path(spark, path)
    spark.stop()


if __name__ == "__main__":
    main()
