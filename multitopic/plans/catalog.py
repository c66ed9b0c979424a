"""Registered queries: one per operator of the inventory, each taking
``(spark, sf_dir)`` and returning a DataFrame in long form with the column
names of its SQL twin (:mod:`multitopic.plans.oracle`, SQL in
``__spark_entry__.oracle_sql``).

Shared setting of the checked queries (deterministic, see D3): the
purchases corpus (customers; product class, supplier nation, event type),
K = 5, symmetric priors (1/K), 'assign' start, gamma starting at ones,
``iterations`` = 50 (the default), ``gamma_threshold`` = 1e-3, epsilon = float32 eps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..operators.vectors import sum_vectors
from ..session import materialize, source_path
from ..sources import corpus as C
from .model import FLOAT32_EPS, TopicModel

K = 5
ITER = 50
THR = 1e-3
EPS = FLOAT32_EPS
CHUNK = 500


def rnd(c: Column | str, d: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, d) + F.lit(0.0)


_CACHE: dict = {}


def _key(spark: SparkSession, sf_dir: str, name: str):
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)


def cached(name: str):
    def deco(fn):
        def wrapper(spark, sf_dir, *a):
            key = _key(spark, sf_dir, name) + a
            if key not in _CACHE:
                _CACHE[key] = fn(spark, sf_dir, *a)
            return _CACHE[key]

        return wrapper

    return deco


@cached("purchases")
def purchases(spark: SparkSession, sf_dir: str) -> C.Corpus:
    terms = materialize(C.purchases(spark, sf_dir), "purchases-terms")
    vocab = materialize(C.vocabulary(terms), "purchases-vocab")
    entries = materialize(C.encode(terms, vocab, strict=False), "purchases-entries")
    return C.Corpus(entries, vocab, 3)


@cached("purchases_terms")
def purchases_terms(spark, sf_dir):
    return materialize(C.purchases(spark, sf_dir), "purchases-terms")


@cached("model_a")
def model_a(spark: SparkSession, sf_dir: str) -> TopicModel:
    return TopicModel.create(purchases(spark, sf_dir), k=K, init="assign", iterations=ITER, gamma_threshold=THR)


def _long(df: DataFrame, arr: str, value: str, keys: list[str], d: int = 6) -> DataFrame:
    return df.select(*keys, F.posexplode(arr).alias("topic", "_v")).select(*keys, "topic", rnd("_v", d).alias(value))


# --------------------------------------------------------------- sources
def q_corpus_purchases(spark, sf):
    t = C.purchases(spark, sf)
    return t.select("doc_id", "type_id", "term", rnd("cnt").alias("cnt"))


def q_corpus_conversations(spark, sf):
    t = C.conversations(spark, sf)
    return t.select("doc_id", "type_id", "term", rnd("cnt").alias("cnt"))


def q_corpus_text(spark, sf):
    t = C.texts(spark, sf)
    return t.select("doc_id", "type_id", "term", rnd("cnt").alias("cnt"))


def q_vocabulary(spark, sf):
    v = purchases(spark, sf).vocab
    return v.select("type_id", "term_id", "term", "doc_freq", rnd("coll_freq").alias("coll_freq"))


def q_num_terms(spark, sf):
    v = purchases(spark, sf).vocab
    return v.groupBy("type_id").agg(F.count("*").alias("num_terms"))


def q_corpus_size(spark, sf):
    s = C.corpus_size(purchases(spark, sf).entries)
    return s.select("type_id", "n_docs", "n_rows", rnd("n_tokens").alias("n_tokens"))


def q_chunk_assignment(spark, sf):
    return C.chunk_assignment(purchases(spark, sf).entries, CHUNK)


def q_doc_lengths(spark, sf):
    return C.doc_lengths(purchases(spark, sf).entries).select("doc_id", rnd("doc_length").alias("doc_length"))


def q_term_frequency(spark, sf):
    c = purchases(spark, sf)
    tf = C.term_frequency(purchases_terms(spark, sf), c.vocab)
    return tf.select("type_id", "term_id", "term", rnd("term_frequency").alias("term_frequency"))


# ----------------------------------------------------------- state tables
def q_topic_lambda(spark, sf):
    return _long(model_a(spark, sf).lam(), "lam", "lam", ["type_id", "term_id"])


def q_topic_term_dists(spark, sf):
    return _long(model_a(spark, sf).topic_term_dists(), "p", "p", ["type_id", "term_id"], 8)


def q_elogbeta(spark, sf):
    return _long(model_a(spark, sf).elogbeta(), "elogbeta", "elogbeta", ["type_id", "term_id"])


def q_exp_elogbeta(spark, sf):
    return _long(model_a(spark, sf).exp_elogbeta(), "eb", "eb", ["type_id", "term_id"], 8)


def q_topic_mass(spark, sf):
    m = model_a(spark, sf)
    return _long(S.topic_mass(m.lam(), m.k), "mass", "mass", ["type_id"])


# ---------------------------------------------------------------- E step
def q_estep_gamma(spark, sf):
    m = model_a(spark, sf)
    g = m.gamma(purchases(spark, sf).entries)
    return _long(g, "gamma", "gamma", ["doc_id"], 4)


def q_doc_topics(spark, sf):
    m = model_a(spark, sf)
    d = m.document_topics(purchases(spark, sf).entries)
    return d.select("doc_id", "topic", rnd("p").alias("p"))


def q_sstats_estep(spark, sf):
    m = model_a(spark, sf)
    ss, _, _, _ = m.sstats(purchases(spark, sf).entries)
    return _long(ss, "vec", "sstat", ["type_id", "term_id"], 4)


def q_estep_convergence(spark, sf):
    m = model_a(spark, sf)
    g = m.gamma(purchases(spark, sf).entries)
    return g.agg(
        F.count("*").alias("n_docs"),
        F.sum(F.col("converged").cast("bigint")).alias("n_converged"),
        F.sum(F.col("iters").cast("bigint")).alias("total_iters"),
    )


def q_phinorm(spark, sf):
    """The corpus joined to exp E[log beta] on (type, term); phinorm at
    the starting gamma (all ones, so exp E[log theta] is constant)."""
    from ..functions.special import digamma_np

    m = model_a(spark, sf)
    et0 = float(__import__("numpy").exp(digamma_np(1.0) - digamma_np(float(m.k))))
    j = purchases(spark, sf).entries.join(m.exp_elogbeta(), ["type_id", "term_id"])
    ph = F.expr("aggregate(eb, 0D, (a, x) -> a + x)") * F.lit(et0) + F.lit(EPS)
    return j.select("doc_id", "type_id", "term_id", rnd(ph, 8).alias("phinorm"))


QUERIES = {
    "corpus_purchases": q_corpus_purchases,
    "corpus_conversations": q_corpus_conversations,
    "corpus_text": q_corpus_text,
    "vocabulary": q_vocabulary,
    "num_terms": q_num_terms,
    "corpus_size": q_corpus_size,
    "chunk_assignment": q_chunk_assignment,
    "doc_lengths": q_doc_lengths,
    "term_frequency": q_term_frequency,
    "topic_lambda": q_topic_lambda,
    "topic_term_dists": q_topic_term_dists,
    "elogbeta": q_elogbeta,
    "exp_elogbeta": q_exp_elogbeta,
    "topic_mass": q_topic_mass,
    "estep_gamma": q_estep_gamma,
    "doc_topics": q_doc_topics,
    "sstats_estep": q_sstats_estep,
    "estep_convergence": q_estep_convergence,
    "phinorm": q_phinorm,
}


# ------------------------------------------------------------ functions
def q_fn_digamma(spark, sf):
    from ..functions.special import digamma_sql

    lam = model_a(spark, sf).lam()
    return _long(lam.select("type_id", "term_id", F.expr(f"transform(lam, x -> {digamma_sql('x')})").alias("v")), "v", "digamma", ["type_id", "term_id"], 8)


def q_fn_trigamma(spark, sf):
    from ..functions.special import trigamma_sql

    lam = model_a(spark, sf).lam()
    return _long(lam.select("type_id", "term_id", F.expr(f"transform(lam, x -> {trigamma_sql('x')})").alias("v")), "v", "trigamma", ["type_id", "term_id"], 8)


def q_fn_lgamma(spark, sf):
    from ..functions.special import lgamma_sql

    lam = model_a(spark, sf).lam()
    return _long(lam.select("type_id", "term_id", F.expr(f"transform(lam, x -> {lgamma_sql('x')})").alias("v")), "v", "lgamma", ["type_id", "term_id"], 6)


# ------------------------------------------------------------ state ops
@cached("model_b")
def model_b(spark, sf):
    return TopicModel.create(purchases(spark, sf), k=K, init="assign", assign_rule="div", iterations=ITER, gamma_threshold=THR)


@cached("sstats_a")
def sstats_a(spark, sf):
    ss, elog, n, m = model_a(spark, sf).sstats(purchases(spark, sf).entries)
    return materialize(ss, "sstats"), elog, n, m


def q_state_merge(spark, sf):
    st = S.merge(model_a(spark, sf).state, model_b(spark, sf).state, K)
    return _long(st, "s", "s", ["type_id", "term_id"], 6)


def q_state_blend(spark, sf):
    ss = sstats_a(spark, sf)[0]
    return _long(S.blend(model_a(spark, sf).state, ss, 0.75, 0.25), "s", "s", ["type_id", "term_id"], 4)


def q_state_blend2(spark, sf):
    ss = sstats_a(spark, sf)[0]
    return _long(S.blend(model_a(spark, sf).state, ss, 1.0, 1.0), "s", "s", ["type_id", "term_id"], 4)


def q_prior_init(spark, sf):
    """M2 on the purchases vocabulary: asymmetric alpha (K values) and the
    symmetric per-term eta of every type."""
    from .model import init_alpha

    a, _ = init_alpha("asymmetric", K)
    m = model_a(spark, sf)
    eta = m.state.select(F.lit("eta").alias("prior"), "type_id", F.col("term_id").alias("idx"), rnd("eta", 8).alias("value"))
    al = spark.createDataFrame([("alpha", -1, i, float(round(v, 8))) for i, v in enumerate(a)], "prior STRING, type_id INT, idx INT, value DOUBLE")
    return eta.unionByName(al.select("prior", "type_id", "idx", rnd("value", 8).alias("value")))


# ------------------------------------------------------------ hyper-parameters
def q_alpha_logphat(spark, sf):
    _, elog, n, _ = sstats_a(spark, sf)
    rows = [(i, float(v / n)) for i, v in enumerate(elog)]
    return spark.createDataFrame(rows, "topic INT, logphat DOUBLE").select("topic", rnd("logphat", 8).alias("logphat"))


def q_alpha_update(spark, sf):
    from ..operators.hyper import alpha_update

    _, elog, n, _ = sstats_a(spark, sf)
    a = alpha_update(model_a(spark, sf).alpha, elog, n, 1.0)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "topic INT, alpha DOUBLE").select("topic", rnd("alpha", 8).alias("alpha"))


def q_eta_logphat(spark, sf):
    from ..operators.hyper import eta_logphat

    return eta_logphat(model_a(spark, sf).state, K).select("type_id", "term_id", rnd("logphat", 8).alias("logphat"))


def q_eta_newton(spark, sf):
    from ..operators.hyper import eta_newton_table

    return eta_newton_table(model_a(spark, sf).state, K, 1.0).select("type_id", "term_id", rnd("eta", 8).alias("eta"))


# ------------------------------------------------------------ training
def fresh_model(spark, sf, **kw) -> TopicModel:
    m = TopicModel.create(purchases(spark, sf), k=K, init="assign", iterations=ITER, gamma_threshold=THR, **kw)
    return m


def q_learning_rate(spark, sf):
    from .train import rho_schedule

    n = purchases(spark, sf).entries.select("doc_id").distinct().count()
    rows = rho_schedule(n, CHUNK, 1, 2)
    return spark.createDataFrame([(p, u, float(r)) for p, u, r in rows], "pass INT, update_no INT, rho DOUBLE").select(
        "pass", "update_no", rnd("rho", 8).alias("rho")
    )


def q_mstep_lambda(spark, sf):
    from .train import do_mstep

    m = fresh_model(spark, sf)
    ss, _, n, _ = sstats_a(spark, sf)
    m.numdocs = 2 * n
    do_mstep(m, 0.5, ss, n)
    return _long(m.lam(), "lam", "lam", ["type_id", "term_id"], 4)


def q_mstep_topic_diff(spark, sf):
    from .train import do_mstep

    m = fresh_model(spark, sf, track_topic_diff=True)
    ss, _, n, _ = sstats_a(spark, sf)
    m.numdocs = 2 * n
    info = do_mstep(m, 0.5, ss, n)
    return spark.createDataFrame([(float(info["topic_diff"]),)], "topic_diff DOUBLE").select(rnd("topic_diff", 8).alias("topic_diff"))


def _chunked(spark, sf, size):
    c = purchases(spark, sf)
    ch = C.chunk_assignment(c.entries, size)
    e = c.entries.join(ch.select("doc_id", "chunk_id"), "doc_id")
    return e


def q_train_batch_1pass(spark, sf):
    from .train import update

    m = fresh_model(spark, sf)
    update(m, purchases(spark, sf).entries, update_every=0, passes=1, eval_every=0)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 4)


def _half(spark, sf) -> int:
    n = purchases(spark, sf).entries.select("doc_id").distinct().count()
    return max(1, -(-n // 2))


def q_train_online_2chunks(spark, sf):
    """Online updates over the documents cut into two chunks (M step after each)."""
    from .train import update

    m = fresh_model(spark, sf)
    update(m, purchases(spark, sf).entries, chunksize=_half(spark, sf), update_every=1, passes=1, eval_every=0)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 4)


def q_train_incremental(spark, sf):
    """A second ``update()`` with new documents (the second half)."""
    from .train import update

    m = fresh_model(spark, sf)
    e = _chunked(spark, sf, _half(spark, sf))
    for c in (0, 1):
        part = e.where(F.col("chunk_id") == c).drop("chunk_id")
        update(m, part, update_every=0, passes=1, eval_every=0)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 4)


def q_train_incremental_chunksize(spark, sf):
    """An explicit chunk size larger than the new documents enters
    the learning rate as given."""
    from .train import update

    m = fresh_model(spark, sf)
    e = _chunked(spark, sf, _half(spark, sf))
    for c in (0, 1):
        part = e.where(F.col("chunk_id") == c).drop("chunk_id")
        update(m, part, chunksize=100_000, update_every=0, passes=1, eval_every=0)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 4)


def q_eta_table(spark, sf):
    """M2: lambda of a start with a per-term eta table."""
    c = purchases(spark, sf)
    eta = c.vocab.select("type_id", "term_id", ((F.col("term_id") + 1) / 10.0).alias("eta"))
    m = TopicModel.create(c, k=K, eta=eta, init="assign")
    return _long(m.lam(), "lam", "lam", ["type_id", "term_id"])


# ------------------------------------------------------------ bound
def q_bound_docs(spark, sf):
    m = model_a(spark, sf)
    return m.bound_docs(purchases(spark, sf).entries).select("doc_id", rnd("score", 4).alias("score"))


def q_bound(spark, sf):
    from .evaluate import bound

    b = bound(model_a(spark, sf), purchases(spark, sf).entries)
    return spark.createDataFrame([(float(b),)], "bound DOUBLE").select(rnd("bound", 3).alias("bound"))


def q_log_perplexity(spark, sf):
    from .evaluate import log_perplexity, perplexity

    m = model_a(spark, sf)
    e = purchases(spark, sf).entries
    pw = log_perplexity(m, m.prepare(e))
    n, words = e.agg(F.countDistinct("doc_id"), F.sum("cnt")).collect()[0]
    return spark.createDataFrame([(float(pw), perplexity(pw), int(n), float(words))], "perwordbound DOUBLE, perplexity DOUBLE, n_docs BIGINT, n_words DOUBLE").select(
        rnd("perwordbound", 8).alias("perwordbound"), rnd("perplexity", 6).alias("perplexity"), "n_docs", rnd("n_words", 4).alias("n_words")
    )


def q_log_perplexity_ratio(spark, sf):
    """The bound of a sample scaled to a corpus of twice its documents."""
    from .evaluate import log_perplexity

    m = model_a(spark, sf)
    e = purchases(spark, sf).entries
    pw = log_perplexity(m, m.prepare(e), total_docs=2 * e.select("doc_id").distinct().count())
    return spark.createDataFrame([(float(pw),)], "perwordbound DOUBLE").select(rnd("perwordbound", 8).alias("perwordbound"))


def q_bound_gamma_supplied(spark, sf):
    """A16 with supplied document weights (here counts per assigned topic + 1)."""
    from .evaluate import bound

    e = purchases(spark, sf).entries
    sums = [F.sum(F.when(F.pmod(F.col("term_id"), F.lit(K)) == i, F.col("cnt")).otherwise(0.0)) + 1.0 for i in range(K)]
    b = bound(model_a(spark, sf), e, gamma=e.groupBy("doc_id").agg(F.array(*sums).alias("gamma")))
    return spark.createDataFrame([(float(b),)], "bound DOUBLE").select(rnd("bound", 3).alias("bound"))


QUERIES.update(
    {
        "fn_digamma": q_fn_digamma,
        "fn_trigamma": q_fn_trigamma,
        "fn_lgamma": q_fn_lgamma,
        "state_merge": q_state_merge,
        "state_blend": q_state_blend,
        "state_blend2": q_state_blend2,
        "prior_init": q_prior_init,
        "alpha_logphat": q_alpha_logphat,
        "alpha_update": q_alpha_update,
        "eta_logphat": q_eta_logphat,
        "eta_newton": q_eta_newton,
        "learning_rate": q_learning_rate,
        "mstep_lambda": q_mstep_lambda,
        "mstep_topic_diff": q_mstep_topic_diff,
        "train_batch_1pass": q_train_batch_1pass,
        "train_online_2chunks": q_train_online_2chunks,
        "train_incremental": q_train_incremental,
        "train_incremental_chunksize": q_train_incremental_chunksize,
        "eta_table": q_eta_table,
        "log_perplexity_ratio": q_log_perplexity_ratio,
        "bound_gamma_supplied": q_bound_gamma_supplied,
        "bound_docs": q_bound_docs,
        "bound": q_bound,
        "log_perplexity": q_log_perplexity,
    }
)


# ------------------------------------------------------------ topics
def q_topic_terms(spark, sf):
    from ..operators.topics import topic_terms

    return topic_terms(model_a(spark, sf), 10).select("topic", "type_id", "rank", "term_id", rnd("p", 8).alias("p"))


def q_show_topic(spark, sf):
    from ..operators.topics import show_topic

    return show_topic(model_a(spark, sf), 0, 10).select("topic", "type_id", "rank", "term", rnd("p", 8).alias("p"))


def q_show_topics(spark, sf):
    from ..operators.topics import show_topics

    return show_topics(model_a(spark, sf), 10, 10, formatted=False).select("topic", "type_id", "rank", "term", rnd("p", 8).alias("p"))


def q_show_topics_formatted(spark, sf):
    from ..operators.topics import show_topics

    return show_topics(model_a(spark, sf), 10, 10, formatted=True)


def q_show_topics_subset(spark, sf):
    from ..operators.topics import show_topics

    return show_topics(model_a(spark, sf), 3, 10, formatted=False).select("topic", "type_id", "rank", "term", rnd("p", 8).alias("p"))


def q_term_topics(spark, sf):
    from ..operators.topics import term_topics

    return term_topics(model_a(spark, sf)).select("type_id", "term_id", "topic", rnd("value", 8).alias("value"))


def q_word_phi(spark, sf):
    return model_a(spark, sf).word_phi(purchases(spark, sf).entries).select(
        "doc_id", "type_id", "term_id", "topic", rnd("nphi", 4).alias("nphi")
    )


def q_word_topics(spark, sf):
    from ..operators.topics import word_topics

    return word_topics(model_a(spark, sf), purchases(spark, sf).entries)


def q_topic_wordset(spark, sf):
    from ..operators.topics import topic_wordsets

    return topic_wordsets(model_a(spark, sf), 30).select("topic", F.array_join("words", "|").alias("words"))


# ------------------------------------------------------------ comparison
def _diff(spark, sf, distance, **kw):
    from ..operators.compare import diff

    d = diff(model_a(spark, sf), model_b(spark, sf), distance, annotation=kw.pop("annotation", False), **kw)
    cols = [F.col("topic1"), F.col("topic2"), rnd("z", 6).alias("z")]
    if "pos" in d.columns:
        cols += [F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg")]
    return d.select(*cols)


def q_topic_diff_kl(spark, sf):
    return _diff(spark, sf, "kullback_leibler")


def q_topic_diff_hellinger(spark, sf):
    return _diff(spark, sf, "hellinger")


def q_topic_diff_self_hellinger(spark, sf):
    """F-9 of a model with itself, normed: the diagonal is exactly 0."""
    from ..operators.compare import diff

    m = model_a(spark, sf)
    return diff(m, m, "hellinger", annotation=False).select("topic1", "topic2", rnd("z").alias("z"), ((F.col("topic1") != F.col("topic2")) | (F.col("z") == 0.0)).alias("exact"))


def q_topic_diff_jaccard(spark, sf):
    return _diff(spark, sf, "jaccard")


def q_topic_diff_js(spark, sf):
    return _diff(spark, sf, "jensen_shannon")


def q_topic_diff_rescaled_dot(spark, sf):
    return _diff(spark, sf, "rescale_dot")


def q_topic_diff_diagonal(spark, sf):
    return _diff(spark, sf, "kullback_leibler", diagonal=True)


def q_topic_diff_annotation(spark, sf):
    return _diff(spark, sf, "hellinger", annotation=True, normed=False)


QUERIES.update(
    {
        "topic_terms": q_topic_terms,
        "show_topic": q_show_topic,
        "show_topics": q_show_topics,
        "show_topics_formatted": q_show_topics_formatted,
        "show_topics_subset": q_show_topics_subset,
        "term_topics": q_term_topics,
        "word_phi": q_word_phi,
        "word_topics": q_word_topics,
        "topic_wordset": q_topic_wordset,
        "topic_diff_kl": q_topic_diff_kl,
        "topic_diff_hellinger": q_topic_diff_hellinger,
        "topic_diff_self_hellinger": q_topic_diff_self_hellinger,
        "topic_diff_jaccard": q_topic_diff_jaccard,
        "topic_diff_js": q_topic_diff_js,
        "topic_diff_rescaled_dot": q_topic_diff_rescaled_dot,
        "topic_diff_diagonal": q_topic_diff_diagonal,
        "topic_diff_annotation": q_topic_diff_annotation,
    }
)


# ------------------------------------------------------------ visualisation tables
def q_vis_topic_term(spark, sf):
    from ..operators.vis import topic_term

    return topic_term(model_a(spark, sf)).select("topic", "type_id", "term_id", rnd("p", 8).alias("p"), rnd("p_joint", 8).alias("p_joint"))


def q_vis_doc_topic(spark, sf):
    from ..operators.vis import doc_topic_dists

    m = model_a(spark, sf)
    g = m.gamma(purchases(spark, sf).entries).select("doc_id", F.posexplode("gamma").alias("topic", "gamma"))
    return doc_topic_dists(m, supplied=g).select("doc_id", "topic", rnd("theta", 6).alias("theta"))


def q_doc_topic_dists_supplied(spark, sf):
    """Document-topic weights supplied as a long table (here the
    quantity-weighted purchase counts per assigned topic), normalised."""
    from ..operators.vis import doc_topic_dists

    e = purchases(spark, sf).entries
    sup = e.groupBy("doc_id", F.pmod(F.col("term_id"), F.lit(K)).alias("topic")).agg(F.sum("cnt").alias("w"))
    return doc_topic_dists(model_a(spark, sf), supplied=sup).select("doc_id", "topic", rnd("theta", 8).alias("theta"))


def q_vis_vocab(spark, sf):
    return purchases(spark, sf).vocab.select("type_id", "term_id", "term")


def _tp(spark, sf):
    from ..operators.vis import doc_topic_dists, topic_proportion

    m = model_a(spark, sf)
    e = purchases(spark, sf).entries
    g = m.gamma(e).select("doc_id", F.posexplode("gamma").alias("topic", "gamma"))
    return topic_proportion(doc_topic_dists(m, supplied=g), C.doc_lengths(e))


def q_vis_topic_proportion(spark, sf):
    tp = _tp(spark, sf)
    return tp.select("topic", rnd("topic_freq", 4).alias("topic_freq"), rnd("proportion", 8).alias("proportion"), "order")


def q_vis_saliency(spark, sf):
    from ..operators.vis import saliency, topic_term

    s = saliency(topic_term(model_a(spark, sf)), materialize(_tp(spark, sf), "tp"))
    return s.select("type_id", "term_id", rnd("distinctiveness", 8).alias("distinctiveness"), rnd("saliency", 8).alias("saliency"))


def q_vis_relevance(spark, sf):
    from ..operators.vis import relevance, topic_term

    r = relevance(topic_term(model_a(spark, sf)), materialize(_tp(spark, sf), "tp"), 0.6, 30)
    return r.select("topic", "rank", "type_id", "term_id", rnd("relevance", 6).alias("relevance"))


def q_vis_topic_distance(spark, sf):
    from ..operators.vis import topic_distance

    return topic_distance(model_a(spark, sf)).select("topic1", "topic2", rnd("z", 8).alias("js"))


# ------------------------------------------------------------ persistence, streaming, no-SQL checks
def q_model_roundtrip(spark, sf):
    from ..session import scratch_path
    from ..sources import model_io

    path = model_io.save(model_a(spark, sf), scratch_path(spark, "model"))
    m = model_io.load(spark, path)
    return _long(m.lam(), "lam", "lam", ["type_id", "term_id"])


def q_state_init(spark, sf):
    """M3: random start, Gamma(100, 1/100) per (type, term, topic)."""
    m = TopicModel.create(purchases(spark, sf), k=K, init="random", seed=7)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 8)


def q_train_online(spark, sf):
    """M1/M11 default path: random start, online updates, two passes, with
    perplexity evaluation; returns the learnt document mixtures."""
    from .train import update

    c = purchases(spark, sf)
    m = TopicModel.create(c, k=K, init="random", seed=11, iterations=ITER, eval_every=1)
    update(m, c.entries, chunksize=CHUNK, passes=2, update_every=1)
    return m.document_topics(c.entries).select("doc_id", "topic", rnd("p").alias("p"))


def q_training_metrics(spark, sf):
    from .train import metrics_frame, update

    c = purchases(spark, sf)
    m = TopicModel.create(c, k=K, init="assign", iterations=ITER, eval_every=1, track_topic_diff=True, alpha="auto")
    update(m, c.entries, chunksize=CHUNK, passes=1, update_every=1)
    return metrics_frame(m)


def q_corpus_from_vectors(spark, sf):
    """The documents' words stored as MLlib sparse count vectors, read
    back into a long corpus (term = vocabulary id)."""
    from ..session import scratch_path

    c = text_corpus(spark, sf)
    vec = C.to_vectors(c.entries, c.vocab, 0, scratch_path(spark, "vectors"))
    return C.corpus_from_vectors(vec, "doc_id", "vec", 0).select("doc_id", "type_id", "term", rnd("cnt").alias("cnt"))


def q_stream_user_days(spark, sf):
    """2.11: events arrive as a stream; every micro-batch of user-day
    documents is one online update of the model."""
    from ..session import scratch_path
    from ..streaming.online import events_stream, train_stream, user_day_terms

    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    terms = C.user_days(ev)
    vocab = materialize(C.vocabulary(terms), "ud-vocab")
    corpus = C.Corpus(C.encode(terms, vocab, strict=False), vocab, 2)
    m = TopicModel.create(corpus, k=K, init="assign", iterations=ITER)
    train_stream(m, events_stream(spark, f"{sf.rstrip('/')}/events.parquet"), user_day_terms, scratch_path(spark, "stream-model"),
                 scratch_path(spark, "stream-ckpt"), update_every=0)
    return _long(m.state, "s", "s", ["type_id", "term_id"], 4)


def q_stream_closed_days(spark, sf):
    """ST5: events in three files in the order of time, cut anywhere in a day,
    and a last row without terms that moves the watermark on: every user-day
    leaves the state once and whole, so the stream's corpus is the table's."""
    from ..session import scratch_path
    from ..streaming.online import closed_user_days, events_stream

    ev = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = ev.select(F.col("ts").cast("double").alias("s")).approxQuantile("s", [0.33, 0.66], 0.01) or [0.0, 0.0]
    s, src = F.col("ts").cast("double"), scratch_path(spark, "stream-events")
    for part in (ev.where(s <= cuts[0]), ev.where((s > cuts[0]) & (s <= cuts[1])), ev.where(s > cuts[1])):
        part.coalesce(1).write.mode("append").parquet(src)
    last = ev.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(
        *[F.col("ts") if c == "ts" else F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in ev.columns]
    )
    last.coalesce(1).write.mode("append").parquet(src)
    out = scratch_path(spark, "stream-closed")
    closed = closed_user_days(events_stream(spark, src))
    q = closed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-ckpt"))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(out).select("doc_id", "type_id", "term", rnd("cnt").alias("cnt"))


def q_stream_scores(spark, sf):
    """ST4: a stream of nested documents through one kernel stage."""
    from ..operators.estep import nest
    from ..session import scratch_path
    from ..streaming.online import score_nested

    nested = materialize(nest(purchases(spark, sf).entries).repartition(3, "doc_id"), "stream-docs")
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(source_path(nested))
    scored = score_nested(model_a(spark, sf), stream)
    out = scratch_path(spark, "stream-scores")
    q = scored.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-ckpt"))
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out).select("doc_id", "topic", rnd("p").alias("p"))


QUERIES.update(
    {
        "stream_closed_days": q_stream_closed_days,
        "stream_scores": q_stream_scores,
        "vis_topic_term": q_vis_topic_term,
        "vis_doc_topic": q_vis_doc_topic,
        "doc_topic_dists_supplied": q_doc_topic_dists_supplied,
        "vis_vocab": q_vis_vocab,
        "vis_topic_proportion": q_vis_topic_proportion,
        "vis_saliency": q_vis_saliency,
        "vis_relevance": q_vis_relevance,
        "vis_topic_distance": q_vis_topic_distance,
        "model_roundtrip": q_model_roundtrip,
        "state_init": q_state_init,
        "train_online": q_train_online,
        "training_metrics": q_training_metrics,
        "corpus_from_vectors": q_corpus_from_vectors,
        "stream_user_days": q_stream_user_days,
    }
)


# ------------------------------------------------------------ strategies under the gate
@cached("texts")
def text_corpus(spark, sf):
    terms = materialize(C.texts(spark, sf), "text-terms")
    vocab = materialize(C.vocabulary(terms), "text-vocab")
    return C.Corpus(materialize(C.encode(terms, vocab, strict=False), "text-entries"), vocab, 3)


def q_estep_text_join(spark, sf):
    """E step over whole document texts (large vocabulary) with the join
    strategy: the topic table is joined to the words, never broadcast."""
    c = text_corpus(spark, sf)
    m = TopicModel.create(c, k=K, init="assign", iterations=ITER, gamma_threshold=THR, strategy="join")
    return m.document_topics(c.entries).select("doc_id", "topic", rnd("p").alias("p"))


def q_estep_hot_docs(spark, sf):
    """E step where every document above 40 entries is treated as hot
    (distributed rounds instead of one task per document)."""
    m = model_a(spark, sf).with_params(max_doc_terms=40)
    m._eb, m._eb_bc = None, None
    g = m.gamma(purchases(spark, sf).entries)
    return _long(g, "gamma", "gamma", ["doc_id"], 4)


def q_estep_gamma_random(spark, sf):
    """D3: the E step with random starts of gamma, the same by co-groups (half
    of the documents as hot ones) as from one broadcast."""
    m = model_a(spark, sf).with_params(gamma_start="random", seed=3, strategy="join", max_doc_terms=60)
    return _long(m.gamma(purchases(spark, sf).entries), "gamma", "gamma", ["doc_id"], 4)


def q_estimator_pipeline(spark, sf):
    """The model as an estimator in a pipeline that is fitted in
    batch mode, saved, loaded and applied: lambda's topic mixtures per document."""
    from pyspark.ml import Pipeline, PipelineModel

    from ..session import scratch_path
    from .estimator import TopicEstimator

    rows = purchases_terms(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("type_id", "term", "cnt")).alias("terms"))
    rows = materialize(rows, "ml-documents")
    est = TopicEstimator(k=K, init="assign", iterations=ITER, gammaThreshold=THR, updateEvery=0)
    path = scratch_path(spark, "ml-pipeline")
    Pipeline(stages=[est]).fit(rows).write().save(path)
    out = PipelineModel.load(path).transform(rows)
    return out.select("doc_id", F.posexplode("topics").alias("topic", "p")).select("doc_id", "topic", rnd("p", 4).alias("p"))


def q_scored_words(spark, sf):
    """One scoring pass for document topics and every word's topics."""
    _, words, _ = model_a(spark, sf).topics_of(purchases(spark, sf).entries, per_word_topics=True)
    return words


def q_merge_many_topics(spark, sf):
    """A1 / A2 / A6 at K = 2000: vectors added up in blocks per term and per type."""
    c = purchases(spark, sf)
    a, b = (S.assign_state(c.entries, c.vocab, 2000, 1.0 / 2000, rule) for rule in ("mod", "div"))
    return _long(sum_vectors(S.merge(a, b, 2000), ["type_id"], 2000, "s", "s"), "s", "s", ["type_id"], 5)


QUERIES.update(
    {
        "estep_text_join": q_estep_text_join,
        "estep_hot_docs": q_estep_hot_docs,
        "estep_gamma_random": q_estep_gamma_random,
        "merge_many_topics": q_merge_many_topics,
        "estimator_pipeline": q_estimator_pipeline,
        "scored_words": q_scored_words,
    }
)
