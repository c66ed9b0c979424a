"""Topic inspection.

Top-n per (type, topic) is a ``row_number() <= n`` window; Spark plans it
with a partial ``WindowGroupLimit`` in every map task, so each group ships
at most n rows per task to the final sort however large the vocabulary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_dists(model) -> DataFrame:
    """``(type_id, term_id, topic, p)``: per type row-normalised lambda."""
    return model.topic_term_dists().select("type_id", "term_id", F.posexplode("p").alias("topic", "p"))


def topic_terms(model, topn: int = 10, topics: list[int] | None = None) -> DataFrame:
    """K1: top-n term ids per (topic, type) by probability (ties: lower
    term id first): ``(topic, type_id, rank, term_id, p)``."""
    d = long_dists(model)
    if topics is not None:
        d = d.where(F.col("topic").isin(list(topics)))
    w = Window.partitionBy("topic", "type_id").orderBy(F.col("p").desc(), F.col("term_id").asc())
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topn).select("topic", "type_id", "rank", "term_id", "p")


def with_words(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Id -> word by join to the vocabulary."""
    return df.join(vocab.select("type_id", "term_id", "term"), ["type_id", "term_id"])


def show_topic(model, topicid: int, topn: int = 10) -> DataFrame:
    """K2: ``(topic, type_id, rank, term, p)`` of one topic."""
    return with_words(topic_terms(model, topn, [topicid]), model.vocab).select("topic", "type_id", "rank", "term", "p")


def choose_topics(alpha: np.ndarray, num_topics: int) -> list[int]:
    """K4: all topics if n < 0 or n >= K (and for n = 0, as the reference's
    slice ``[-0:]`` is the whole list); otherwise the n//2 lowest-alpha and
    ceil(n/2) highest-alpha topics, ties broken by topic id (D7)."""
    k = len(alpha)
    if num_topics < 0 or num_topics >= k:
        return list(range(k))
    order = sorted(range(k), key=lambda i: (alpha[i], i))
    if num_topics == 0:
        return order
    return order[: num_topics // 2] + order[-((num_topics + 1) // 2) :]


def show_topics(model, num_topics: int = 10, num_words: int = 10, formatted: bool = True) -> DataFrame:
    """``(topic, type_id, repr)`` with repr ``'%.3f*"word" + ...'``
    (or raw ``(topic, type_id, rank, term, p)`` rows)."""
    chosen = choose_topics(model.alpha, num_topics)
    tw = with_words(topic_terms(model, num_words, chosen), model.vocab)
    if not formatted:
        return tw.select("topic", "type_id", "rank", "term", "p")
    item = F.struct(F.col("rank"), F.format_string('%.3f*"%s"', F.col("p"), F.col("term")).alias("s"))
    g = tw.groupBy("topic", "type_id").agg(F.array_sort(F.collect_list(item)).alias("_it"))
    return g.select("topic", "type_id", F.array_join(F.transform("_it", lambda x: x["s"]), " + ").alias("repr"))


def term_topics(model, minimum_probability: float | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Topics of each term with exp E[log beta] >= max(min, 1e-8);
    ``terms`` (type_id, term) restricts to given words (joined to the
    vocabulary). ``(type_id, term_id, topic, value)``."""
    mp = model.params.minimum_probability if minimum_probability is None else minimum_probability
    mp = max(mp, 1e-8)
    eb = model.exp_elogbeta()
    if terms is not None:
        ids = terms.select("type_id", "term").join(model.vocab.select("type_id", "term", "term_id"), ["type_id", "term"])
        eb = eb.join(ids.select("type_id", "term_id"), ["type_id", "term_id"])
    return eb.select("type_id", "term_id", F.posexplode("eb").alias("topic", "value")).where(F.col("value") >= F.lit(mp))


def word_topics(model, entries: DataFrame, minimum_phi_value: float | None = None) -> DataFrame:
    """K6: per (doc, type, term) the topics with n*phi >= threshold sorted by
    n*phi descending, ties: higher topic first. ``(doc_id, type_id,
    term_id, rank, topic)``."""
    from .estep import PHI

    mphi = max(model.params.minimum_phi_value if minimum_phi_value is None else minimum_phi_value, 1e-8)
    return ranked_topics(model.estep_rows(entries, "phi", min_phi=mphi).where(F.col("kind") == PHI), mphi)


def ranked_topics(rows: DataFrame, mphi: float) -> DataFrame:
    """The same of the kernel's rows of n*phi vectors."""
    # the kernel returns one vector per (doc, term): sorted in the row, no shuffle
    kept = F.filter(F.transform("vec", lambda x, i: F.struct(x.alias("v"), i.alias("topic"))), lambda e: e["v"] >= mphi)
    ranked = rows.select("doc_id", "type_id", "term_id", F.posexplode(F.reverse(F.array_sort(kept))).alias("_r", "_e"))
    return ranked.select("doc_id", "type_id", "term_id", (F.col("_r") + 1).alias("rank"), F.col("_e.topic").alias("topic"))


def topic_wordsets(model, num_words: int = 30) -> DataFrame:
    """Per topic the set of words among the top ``num_words`` of every
    type (one set over all types): ``(topic, words ARRAY<STRING>)`` sorted."""
    tw = with_words(topic_terms(model, num_words), model.vocab)
    return tw.groupBy("topic").agg(F.array_sort(F.collect_set("term")).alias("words"))
