"""Tables for a topic browser.

``extract`` returns the five inputs a browser needs, keyed DataFrames
instead of dense arrays; ``prepare`` adds the tables an LDAvis-style
browser derives from them (Sievert & Shirley 2014; Chuang et al. 2012):
topic proportions, term saliency, relevance top-R and inter-topic
Jensen-Shannon distances. The 2-D layout and HTML rendering are not built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import corpus as C


def doc_topic_dists(model, entries: DataFrame | None = None, supplied: DataFrame | None = None) -> DataFrame:
    """``(doc_id, topic, theta)``. ``supplied`` may be long
    ``(doc_id, topic, p)`` or ``(doc_id, theta ARRAY)``; it is normalised per
    document (D15). Otherwise inferred with the model (the costly part)."""
    if supplied is not None:
        if "topic" in supplied.columns:
            value = [c for c in supplied.columns if c not in ("doc_id", "topic")][0]
            if supplied.where((F.col("topic") < 0) | (F.col("topic") >= model.k) | F.col("topic").isNull()).limit(1).count():
                raise ValueError(f"supplied topics lie outside 0..{model.k - 1}")
            cells = F.collect_list(F.struct(F.col("topic"), F.col(value).alias("v")))  # at most K cells a document
            total = supplied.groupBy("doc_id").agg(cells.alias("_c"), F.sum(value).alias("_s"))
            out = total.select("doc_id", "_s", F.explode("_c").alias("_x")).select("doc_id", F.col("_x.topic").alias("topic"), (F.col("_x.v") / F.col("_s")).alias("theta"))
            return out
        arr = [c for c in supplied.columns if c != "doc_id"][0]
        if supplied.where(F.coalesce(F.size(arr), F.lit(0)) != model.k).limit(1).count():
            raise ValueError(f"supplied topic weights need {model.k} values per document")
        share = F.expr(f"transform({arr}, x -> x / aggregate({arr}, 0D, (a, y) -> a + y))")  # in the row: no shuffle
        return supplied.select("doc_id", F.posexplode(share).alias("topic", "theta"))
    t = model.transform(entries)
    return t.select("doc_id", F.posexplode("theta").alias("topic", "theta"))


def topic_term(model) -> DataFrame:
    """V2: per type row-normalised topic-term probabilities; over the
    concatenated types a topic sums to T (D11), ``p_joint`` = p / T sums to 1."""
    t = model.num_types
    d = model.topic_term_dists().select("type_id", "term_id", F.posexplode("p").alias("topic", "p"))
    return d.select("topic", "type_id", "term_id", "p", (F.col("p") / F.lit(float(t))).alias("p_joint"))


def check_terms(model, entries: DataFrame) -> None:
    """V4: term ids within the model's vocabulary."""
    sizes = F.array(*[F.lit(int(n)) for n in model.num_terms])
    inside = F.col("type_id").between(0, model.num_types - 1) & F.col("term_id").between(0, F.get(sizes, F.col("type_id")) - 1)
    if entries.where(~F.coalesce(inside, F.lit(False))).limit(1).count():
        raise ValueError("the corpus holds term ids that the model does not know")

def check_documents(entries: DataFrame, doc_topic: DataFrame) -> None:
    """V4: topic weights for every document of the corpus."""
    docs, given = entries.select("doc_id").distinct(), doc_topic.select("doc_id").distinct()
    if docs.join(given, "doc_id", "left_anti").limit(1).count():
        raise ValueError("some documents of the corpus have no topic weights")


def prepare(model, terms: DataFrame, entries: DataFrame, supplied: DataFrame | None = None, lam: float = 0.6, r: int = 30) -> dict[str, DataFrame]:
    """V3: everything a browser reads, from one E step: the five tables of
    :func:`extract` plus topic_proportion, saliency, relevance, topic_distance."""
    from ..session import materialize

    check_terms(model, entries)
    out = extract(model, terms, entries, supplied)
    out["doc_topic_dists"] = materialize(out["doc_topic_dists"], "browser-doc-topics")
    check_documents(entries, out["doc_topic_dists"])
    tp = materialize(topic_proportion(out["doc_topic_dists"], out["doc_lengths"]), "browser-proportions")
    tt = out["topic_term_dists"]
    return out | {"topic_proportion": tp, "saliency": saliency(tt, tp), "relevance": relevance(tt, tp, lam, r), "topic_distance": topic_distance(model)}


def extract(model, terms: DataFrame, entries: DataFrame, supplied: DataFrame | None = None) -> dict[str, DataFrame]:
    """V1: topic_term_dists, doc_topic_dists, doc_lengths, vocab,
    term_frequency (``terms`` is the un-encoded corpus)."""
    return {
        "topic_term_dists": topic_term(model),
        "doc_topic_dists": doc_topic_dists(model, entries, supplied),
        "doc_lengths": C.doc_lengths(entries),
        "vocab": model.vocab.select("type_id", "term_id", "term"),
        "term_frequency": C.term_frequency(terms, model.vocab),
    }


def topic_proportion(doc_topic: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """V3: topic frequency sum_d theta_dk * len_d, its share, and the order
    by share (1 = largest; ties by topic id)."""
    f = doc_topic.join(doc_lengths, "doc_id").groupBy("topic").agg(F.sum(F.col("theta") * F.col("doc_length")).alias("topic_freq"))
    w = Window.orderBy(F.col("topic_freq").desc(), F.col("topic").asc())  # K rows only
    total = F.sum("topic_freq").over(Window.partitionBy())
    return f.select("topic", "topic_freq", (F.col("topic_freq") / total).alias("proportion")).withColumn("order", F.row_number().over(w))


def term_marginal(tt: DataFrame, tp: DataFrame) -> DataFrame:
    """Term frequency implied by the model: sum_k phi_kw * topic_freq_k and
    its share p_w (``tt`` from :func:`topic_term`, ``tp`` from
    :func:`topic_proportion`)."""
    tf = tt.join(F.broadcast(tp.select("topic", "topic_freq")), "topic").groupBy("type_id", "term_id").agg(
        F.sum(F.col("p_joint") * F.col("topic_freq")).alias("freq")
    )
    tot = tf.agg(F.sum("freq")).collect()[0][0] or 1.0
    return tf.select("type_id", "term_id", "freq", (F.col("freq") / F.lit(float(tot))).alias("p_w"))


def saliency(tt: DataFrame, tp: DataFrame) -> DataFrame:
    """saliency_w = p_w * sum_k p(k|w) log(p(k|w) / p(k)), p(k|w) =
    phi_kw / sum_k phi_kw (topic count rows per term only)."""
    tm = term_marginal(tt, tp)
    colsum = tt.groupBy("type_id", "term_id").agg(F.sum("p_joint").alias("_cs"))
    x = tt.join(colsum, ["type_id", "term_id"]).join(F.broadcast(tp.select("topic", "proportion")), "topic")
    kern = (F.col("p_joint") / F.col("_cs")) * F.log((F.col("p_joint") / F.col("_cs")) / F.col("proportion"))
    dist = x.groupBy("type_id", "term_id").agg(F.sum(kern).alias("distinctiveness"))
    return dist.join(tm, ["type_id", "term_id"]).select("type_id", "term_id", "distinctiveness", (F.col("p_w") * F.col("distinctiveness")).alias("saliency"))


def relevance(tt: DataFrame, tp: DataFrame, lam: float = 0.6, r: int = 30) -> DataFrame:
    """Top-R terms per topic by lam * log(phi) + (1 - lam) * log(phi / p_w);
    ties by (type_id, term_id). Partial top-R in every map task."""
    tm = term_marginal(tt, tp)
    x = tt.join(tm, ["type_id", "term_id"]).select(
        "topic", "type_id", "term_id", (F.lit(lam) * F.log("p_joint") + F.lit(1.0 - lam) * F.log(F.col("p_joint") / F.col("p_w"))).alias("relevance")
    )
    w = Window.partitionBy("topic").orderBy(F.col("relevance").desc(), F.col("type_id"), F.col("term_id"))
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= r)


def topic_distance(model) -> DataFrame:
    """Inter-topic Jensen-Shannon divergence (input of the 2-D layout)."""
    from .compare import diff

    return diff(model, model, "jensen_shannon", annotation=False, normed=False)
