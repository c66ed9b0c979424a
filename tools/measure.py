"""

usage: python tools/measure.py [sf_dir] [cores] [what]
  what = all | estep   (estep: only the E-step scaling point for `cores`)
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def force(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cores = sys.argv[2] if len(sys.argv) > 2 else "8"
    what = sys.argv[3] if len(sys.argv) > 3 else "all"
    from multitopic.operators.compare import diff
    from multitopic.plans.model import TopicModel
    from multitopic.plans.train import update
    from multitopic.session import local_session, materialize
    from multitopic.sources import corpus as C

    spark = local_session(cores, shuffle_partitions=max(8, 2 * int(cores)), app="multitopic-measure")
    terms = materialize(C.purchases(spark, sf), "m-terms")
    vocab = materialize(C.vocabulary(terms), "m-vocab")
    corp = C.Corpus(materialize(C.encode(terms, vocab, strict=False), "m-entries"), vocab, 3)
    n_docs = corp.entries.select("doc_id").distinct().count()
    n_tok = corp.entries.agg({"cnt": "sum"}).collect()[0][0]
    out = {"sf": sf, "cores": cores, "docs": n_docs, "tokens": n_tok}

    def estep(k, strategy):
        m = TopicModel.create(corp, k=k, init="assign", strategy=strategy)
        m.exp_elogbeta().count()
        prep = m.prepare(corp.entries)
        force(m.rows(prep, "gamma"))  # warm-up (Python workers, broadcast)
        t0 = time.time()
        force(m.rows(prep, "gamma"))
        dt = time.time() - t0
        return {"sec": round(dt, 3), "docs_per_sec": round(n_docs / dt, 1), "tokens_per_sec": round(n_tok / dt, 1)}

    if what == "estep":
        out["estep_broadcast_k20"] = estep(20, "broadcast")
        print(json.dumps(out))
        return
    for k in (20, 100):
        for s in ("broadcast", "join"):
            out[f"estep_{s}_k{k}"] = estep(k, s)

    m = TopicModel.create(corp, k=100, init="random", seed=5)
    t0 = time.time()
    update(m, corp.entries, chunksize=2000, passes=1, update_every=1, eval_every=0)
    steps = len([x for x in m.metrics if x["metric"] == "rho"])
    out["train_k100"] = {"sec": round(time.time() - t0, 3), "msteps": steps, "sec_per_mstep": round((time.time() - t0) / steps, 3)}

    m20 = TopicModel.create(corp, k=20, init="assign")
    t0 = time.time()
    force(m20.document_topics(corp.entries))
    dt = time.time() - t0
    out["score_k20"] = {"sec": round(dt, 3), "docs_per_sec": round(n_docs / dt, 1)}

    a = TopicModel.create(corp, k=100, init="assign")
    b = TopicModel.create(corp, k=100, init="assign", assign_rule="div")
    per = {}
    for d in ("kullback_leibler", "hellinger", "jensen_shannon", "jaccard", "rescale_dot"):
        t0 = time.time()
        force(diff(a, b, d, annotation=False))
        per[d] = round(time.time() - t0, 3)
    out["topic_diff_100x100"] = per
    print(json.dumps(out))


if __name__ == "__main__":
    main()
