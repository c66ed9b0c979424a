"""Topic state as a DataFrame and the operators on it.

State table: ``(type_id INT, term_id INT, s ARRAY<DOUBLE>[K], eta0 DOUBLE,
eta DOUBLE)`` -- one row per vocabulary term; ``s`` holds the sufficient
statistics of every topic for that term, ``eta0`` the prior used for lambda
(fixed at construction, D6) and ``eta`` the current (possibly optimised)
prior used by the bound.

All K-vector maths runs JVM-side with higher-order array functions; the
only driver-sized values are per-(type, topic) totals (T x K numbers).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma_sql
from .vectors import sum_vectors

LAMBDA_SQL = "transform(s, x -> x + eta0)"


def lam(state: DataFrame) -> DataFrame:
    """lambda = eta0 + S."""
    return state.select("type_id", "term_id", F.expr(LAMBDA_SQL).alias("lam"))


def topic_mass(lam_df: DataFrame, k: int, col: str = "lam") -> DataFrame:
    """Sum over the terms of a type of lambda, per topic: ``(type_id,
    mass ARRAY[K])`` -- T rows (partial + final aggregation)."""
    return sum_vectors(lam_df, ["type_id"], k, col, "mass")


def elogbeta(lam_df: DataFrame, k: int, col: str = "lam") -> DataFrame:
    """P3 / F-4: E[log beta] = psi(lambda) - psi(row sum), per type. The
    T x K row sums are joined back by broadcast (T rows)."""
    mass = topic_mass(lam_df, k, col).select(
        "type_id", F.expr(f"transform(mass, x -> {digamma_sql('x')})").alias("_psum")
    )
    return lam_df.join(F.broadcast(mass), "type_id").select(
        "type_id",
        "term_id",
        F.expr(f"zip_with(transform({col}, x -> {digamma_sql('x')}), _psum, (a, b) -> a - b)").alias("elogbeta"),
    )


def exp_elogbeta(elog: DataFrame) -> DataFrame:
    """Exp E[log beta]."""
    return elog.select("type_id", "term_id", F.expr("transform(elogbeta, x -> exp(x))").alias("eb"))


def topic_term_dists(lam_df: DataFrame, k: int, col: str = "lam") -> DataFrame:
    """Lambda row-normalised per (type, topic)."""
    mass = topic_mass(lam_df, k, col)
    return lam_df.join(F.broadcast(mass), "type_id").select(
        "type_id", "term_id", F.expr(f"zip_with({col}, mass, (a, b) -> a / b)").alias("p")
    )


def blend(state: DataFrame, sstats: DataFrame, w_old: float, w_new: float) -> DataFrame:
    """A3: S' = w_old * S + w_new * sstats (sstats may miss terms -> 0)."""
    j = state.join(sstats.select("type_id", "term_id", F.col("vec").alias("_ss")), ["type_id", "term_id"], "left")
    wo, wn = F.lit(float(w_old)), F.lit(float(w_new))
    s_new = F.when(
        F.col("_ss").isNull(), F.transform("s", lambda x: x * wo)
    ).otherwise(F.zip_with("s", "_ss", lambda a, b: a * wo + b * wn))
    return j.select("type_id", "term_id", s_new.alias("s"), "eta0", "eta")


def blend_arrays(s: np.ndarray, sstats: np.ndarray, w_old: float, w_new: float) -> np.ndarray:
    """A3 on the arrays of a small state; terms without statistics have zeros."""
    return s * float(w_old) + sstats * float(w_new)


def stretch(docs: int, target: int) -> float:
    """Factor that makes statistics of ``docs`` documents stand for ``target``."""
    return target / docs if docs else 1.0


def blend_states(state: DataFrame, docs: int, sstats: DataFrame, other_docs: int, rho: float, target: int | None = None) -> tuple[DataFrame, int]:
    """A3 with document counts: both sides are stretched to ``target``
    documents (default: the state's own) and weighted 1 - rho and rho;
    returns the state and its document count."""
    target = docs if target is None else target
    return blend(state, sstats, (1.0 - rho) * stretch(docs, target), rho * stretch(other_docs, target)), target


def blend2_states(state: DataFrame, docs: int, sstats: DataFrame, target: int | None = None) -> tuple[DataFrame, int]:
    """A4 with document counts: a plain sum that stands for ``target`` documents."""
    return blend(state, sstats, 1.0, 1.0), docs if target is None else target


def merge_states(a: DataFrame, docs_a: int, b: DataFrame, docs_b: int, k: int) -> tuple[DataFrame, int]:
    """A2 with document counts."""
    return merge(a, b, k), docs_a + docs_b


def merge(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """A2: exact distributive sum of two states' statistics."""
    u = a.select("type_id", "term_id", "s", "eta0", "eta").unionByName(b.select("type_id", "term_id", "s", "eta0", "eta"))
    priors = u.groupBy("type_id", "term_id").agg(F.first("eta0").alias("eta0"), F.first("eta").alias("eta"))
    return sum_vectors(u, ["type_id", "term_id"], k, "s", "s").join(priors, ["type_id", "term_id"])


def scale(state: DataFrame, factor: float) -> DataFrame:
    f = F.lit(float(factor))
    return state.select("type_id", "term_id", F.transform("s", lambda x: x * f).alias("s"), "eta0", "eta")


def zero_state(vocab: DataFrame, k: int, eta0: DataFrame | float) -> DataFrame:
    """A5: reset -- all statistics zero."""
    base = vocab.select("type_id", "term_id")
    base = _with_eta(base, eta0)
    return base.select("type_id", "term_id", F.array_repeat(F.lit(0.0), k).alias("s"), "eta0", "eta")


def _with_eta(base: DataFrame, eta0) -> DataFrame:
    if isinstance(eta0, DataFrame):
        given = eta0.select("type_id", "term_id", F.col("eta").cast("double").alias("eta0"))
        if given.groupBy("type_id", "term_id").count().where("count > 1").limit(1).count():
            raise ValueError("the eta table holds a term twice")
        both = base.join(given, ["type_id", "term_id"], "left")
        if both.where(F.col("eta0").isNull()).limit(1).count():
            raise ValueError("the eta table has no value for some vocabulary terms")
        return both.withColumn("eta", F.col("eta0"))
    if isinstance(eta0, dict):
        missing = {r[0] for r in base.select("type_id").distinct().collect()} - set(eta0)  # T rows
        if missing:
            raise ValueError(f"eta has no value for the types {sorted(missing)}")
        e = F.lit(None).cast("double")
        for t, v in eta0.items():
            e = F.when(F.col("type_id") == t, F.lit(float(v))).otherwise(e)
        return base.withColumn("eta0", e).withColumn("eta", F.col("eta0"))
    return base.withColumn("eta0", F.lit(float(eta0))).withColumn("eta", F.lit(float(eta0)))


def assign_state(entries: DataFrame, vocab: DataFrame, k: int, eta0, rule: str = "mod") -> DataFrame:
    """Deterministic start (D3, init='assign'): document d belongs to topic
    ``pmod(d, K)`` (rule 'mod') or ``pmod(d div K, K)`` (rule 'div');
    S[k, w] = sum of counts of w over the documents of topic k."""
    topic = F.pmod(F.col("doc_id"), F.lit(k)) if rule == "mod" else F.pmod(F.floor(F.col("doc_id") / F.lit(k)), F.lit(k))
    # a term has a row per topic it occurs in, at most K
    per = entries.groupBy("type_id", "term_id", topic.cast("int").alias("_k")).agg(F.sum("cnt").cast("double").alias("_c"))
    agg = per.groupBy("type_id", "term_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_c"))).alias("_m"))
    agg = agg.select("type_id", "term_id", F.expr(f"transform(sequence(0, {k - 1}), i -> coalesce(_m[i], 0D))").alias("_s"))
    base = _with_eta(vocab.select("type_id", "term_id"), eta0)
    return base.join(agg, ["type_id", "term_id"], "left").select(
        "type_id", "term_id", F.coalesce("_s", F.array_repeat(F.lit(0.0), k)).alias("s"), "eta0", "eta"
    )


def random_state(vocab: DataFrame, k: int, eta0, seed: int = 0, shape: float = 100.0) -> DataFrame:
    """M3: S ~ Gamma(shape, 1/shape) per (type, term, topic), seeded by a hash
    of the key (independent of partitioning; md5, so that any engine can
    repeat the draws). Draws use the Wilson-Hilferty transform of a Box-Muller
    normal built from two hashed uniforms (52 bits each)."""
    base = _with_eta(vocab.select("type_id", "term_id"), eta0)
    return base.select("type_id", "term_id", gamma_draws("type_id, term_id", k, seed, shape).alias("s"), "eta0", "eta")


def gamma_draws(keys: str, k: int, seed: int = 0, shape: float = 100.0):
    """K draws of Gamma(shape, 1/shape) per row, from hashes of (seed, keys, topic)."""
    u = lambda salt: (
        f"((cast(conv(substring(md5(concat_ws(':', {int(seed)}, {salt}, {keys}, i)), 1, 13), 16, 10) as double) + 0.5D) / 4503599627370496.0D)"
    )
    z = f"(sqrt(-2.0D * ln({u(1)})) * cos(6.283185307179586D * {u(2)}))"
    c = 1.0 / (9.0 * shape)
    g = f"greatest(1e-12D, power(1.0D - {c!r}D + {z} * {float(np.sqrt(c))!r}D, 3))"
    return F.expr(f"transform(sequence(0, {k - 1}), i -> {g})")


def state_long(state: DataFrame, col: str = "s") -> DataFrame:
    """Long form ``(type_id, term_id, topic, value)`` for SQL/oracle use."""
    return state.select("type_id", "term_id", F.posexplode(col).alias("topic", "value"))


def mean_abs_change(old: DataFrame, new: DataFrame, k: int, num_types: int) -> float:
    """Mean |old - new| of E[log beta] per type, then mean over types."""
    j = old.select("type_id", "term_id", F.col("elogbeta").alias("_o")).join(
        new.select("type_id", "term_id", F.col("elogbeta").alias("_n")), ["type_id", "term_id"]
    )
    d = j.select(
        "type_id",
        F.expr("aggregate(zip_with(_o, _n, (a, b) -> abs(a - b)), 0D, (acc, x) -> acc + x)").alias("_d"),
    )
    per_type = d.groupBy("type_id").agg((F.sum("_d") / (F.count("*") * F.lit(k))).alias("m")).collect()
    return float(np.mean([r["m"] for r in per_type])) if per_type else 0.0
