"""DuckDB SQL twins of the registered queries (the correctness oracle).

Everything is written in long form (one row per topic) over the raw
tables: corpus and vocabulary built in SQL, the deterministic 'assign'
state, exp E[log beta], and the E step unrolled as a chain of CTEs (one
group per round, converged documents frozen by a flag). The gamma-family
functions come from the same series as the engine
(:mod:`multitopic.functions.special`), since DuckDB has no digamma.
"""

from __future__ import annotations

import numpy as np

from ..functions.special import digamma_np, digamma_sql, lgamma_sql, trigamma_sql

psi = digamma_sql


def with_(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def rnd(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"


# ------------------------------------------------------------------ corpora
def purchases_terms() -> list[str]:
    return [
        "t0 AS (SELECT o_custkey::BIGINT AS doc_id, 0 AS type_id, concat_ws('|', p_brand, p_type) AS term, "
        "sum(l_quantity)::DOUBLE AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)",
        "t1 AS (SELECT o_custkey::BIGINT AS doc_id, 1 AS type_id, n_name AS term, count(*)::DOUBLE AS cnt "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey "
        "JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)",
        "t2 AS (SELECT user_id::BIGINT AS doc_id, 2 AS type_id, event_type AS term, count(*)::DOUBLE AS cnt "
        "FROM events GROUP BY 1, 2, 3)",
        "terms AS (SELECT * FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2) "
        "WHERE cnt > 0 AND term IS NOT NULL AND doc_id IS NOT NULL)",
    ]


TOKENS = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}]+'), lambda w: length(w) > 0)"


def conversation_terms() -> list[str]:
    return [
        "cv AS (SELECT conv_id::BIGINT AS doc_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 "
        "WHEN 'assistant' THEN 2 END AS type_id, text FROM conversations)",
        f"tok AS (SELECT doc_id, type_id, unnest({TOKENS.format(x='text')}) AS term FROM cv WHERE type_id IS NOT NULL)",
        "terms AS (SELECT doc_id, type_id, term, count(*)::DOUBLE AS cnt FROM tok GROUP BY 1, 2, 3)",
    ]


def text_terms() -> list[str]:
    return [
        f"tok AS (SELECT doc_id::BIGINT AS doc_id, 0 AS type_id, unnest({TOKENS.format(x='text')}) AS term FROM documents)",
        "terms AS (SELECT doc_id, type_id, term, count(*)::DOUBLE AS cnt FROM tok GROUP BY 1, 2, 3 "
        "UNION ALL SELECT doc_id::BIGINT, 1, source, count(*)::DOUBLE FROM documents WHERE source IS NOT NULL GROUP BY 1, 2, 3 "
        "UNION ALL SELECT doc_id::BIGINT, 2, lang, count(*)::DOUBLE FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2, 3)",
    ]


def vocab_entries() -> list[str]:
    return [
        "vocab AS (SELECT type_id, term, (row_number() OVER (PARTITION BY type_id ORDER BY term) - 1)::INT AS term_id, "
        "count(*)::BIGINT AS doc_freq, sum(cnt)::DOUBLE AS coll_freq FROM terms GROUP BY type_id, term)",
        "entries AS (SELECT t.doc_id, t.type_id, v.term_id, t.cnt FROM terms t JOIN vocab v ON t.type_id = v.type_id AND t.term = v.term)",
    ]


# ------------------------------------------------------------------- model
def assign_ctes(k: int, eta: float | None = None, rule: str = "mod", prefix: str = "") -> list[str]:
    """``{prefix}topics`` and the deterministic 'assign' state ``{prefix}st``
    (type_id, term_id, topic, s, eta0)."""
    eta = 1.0 / k if eta is None else eta
    topic = f"(((doc_id % {k}) + {k}) % {k})" if rule == "mod" else f"(((floor(doc_id / {k})::BIGINT % {k}) + {k}) % {k})"
    p = prefix
    return [
        f"{p}topics AS (SELECT range::INT AS topic FROM range({k}))",
        f"{p}sa AS (SELECT type_id, term_id, {topic}::INT AS topic, sum(cnt) AS s FROM entries GROUP BY 1, 2, 3)",
        f"{p}st AS (SELECT v.type_id, v.term_id, k.topic, coalesce(sa.s, 0.0)::DOUBLE AS s, {eta!r}::DOUBLE AS eta0 "
        f"FROM vocab v CROSS JOIN {p}topics k LEFT JOIN {p}sa sa ON sa.type_id = v.type_id AND sa.term_id = v.term_id AND sa.topic = k.topic)",
    ]


def derive_ctes(prefix: str = "") -> list[str]:
    """From ``{prefix}st``: ``lam``, ``mass``, ``pmass``, ``elog``, ``eb``."""
    p = prefix
    return [
        f"{p}lam AS (SELECT type_id, term_id, topic, s + eta0 AS lam, eta0 FROM {p}st)",
        f"{p}mass AS (SELECT type_id, topic, sum(lam) AS mass FROM {p}lam GROUP BY 1, 2)",
        f"{p}pmass AS (SELECT type_id, topic, {psi('mass')} AS pm FROM {p}mass)",
        f"{p}elog AS MATERIALIZED (SELECT l.type_id, l.term_id, l.topic, {psi('l.lam')} - p.pm AS elogbeta "
        f"FROM {p}lam l JOIN {p}pmass p ON l.type_id = p.type_id AND l.topic = p.topic)",
        f"{p}eb AS (SELECT type_id, term_id, topic, exp(elogbeta) AS eb FROM {p}elog)",
    ]


def model_ctes(k: int, eta: float | None = None, rule: str = "mod", prefix: str = "") -> list[str]:
    return assign_ctes(k, eta, rule, prefix) + derive_ctes(prefix)


def mstep_ctes(prev: str, new: str, sst: str, w_old, w_new) -> list[str]:
    """``{new}st`` = w_old * ``{prev}st`` + w_new * sstats, then derived
    tables (weights: numbers or scalar SQL expressions)."""
    return [
        f"{new}st AS MATERIALIZED (SELECT a.type_id, a.term_id, a.topic, ({w_old}) * a.s + ({w_new}) * coalesce(b.sstat, 0.0) AS s, a.eta0 "
        f"FROM {prev}st a LEFT JOIN {sst} b ON a.type_id = b.type_id AND a.term_id = b.term_id AND a.topic = b.topic)"
    ] + derive_ctes(new)


def draw_sql(seed: int, keys: str) -> str:
    """A draw of Gamma(100, 1/100) from hashes of (seed, keys)."""
    u = [f"((('0x' || substring(md5(concat_ws(':', {seed}, {salt}, {keys})), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)" for salt in (1, 2)]
    z = f"(sqrt(-2.0 * ln({u[0]})) * cos(2.0 * pi() * {u[1]}))"
    return f"greatest(1e-12, pow(1.0 - 1.0 / 900.0 + {z} * sqrt(1.0 / 900.0), 3))"


def estep_ctes(k: int, num_types: int, rounds: int, thr: float, eps: float, alpha=None, tag: str = "", eb: str = "eb",
               entries: str = "entries", docs: str | None = None, seed: int | None = None) -> list[str]:
    """Unrolled E step; the last CTE ``{tag}g{rounds}`` holds (doc_id, topic,
    gamma, et, done, iters); ``{tag}phf`` the final phinorm per entry. Gamma
    starts at ones, or at the draws of ``seed``."""
    alpha = np.full(k, 1.0 / k) if alpha is None else np.asarray(alpha, dtype=float)
    et0 = float(np.exp(digamma_np(1.0) - digamma_np(float(k))))
    vals = ", ".join(f"({i}, {float(a)!r}::DOUBLE)" for i, a in enumerate(alpha))
    t = tag
    docs_sql = docs or f"SELECT DISTINCT doc_id FROM {entries}"
    c = [
        f"{t}alpha AS (SELECT * FROM (VALUES {vals}) v(topic, alpha))",
        f"{t}docs AS ({docs_sql})",
        f"{t}g0 AS (SELECT d.doc_id, a.topic, 1.0::DOUBLE AS gamma, {et0!r}::DOUBLE AS et, false AS done, 0 AS iters "
        f"FROM {t}docs d CROSS JOIN {t}alpha a)",
    ]
    if seed is not None:
        c[-1:] = [
            f"{t}d0 AS (SELECT d.doc_id, a.topic, {draw_sql(seed, f"'doc', d.doc_id, a.topic")} AS gamma FROM {t}docs d CROSS JOIN {t}alpha a)",
            f"{t}g0 AS MATERIALIZED (SELECT doc_id, topic, gamma, exp({psi('gamma')} - {psi('gs')}) AS et, false AS done, 0 AS iters "
            f"FROM (SELECT *, sum(gamma) OVER (PARTITION BY doc_id) AS gs FROM {t}d0))",
        ]
    for r in range(1, rounds + 1):
        prev = f"{t}g{r - 1}"
        c += [
            f"{t}ph{r} AS MATERIALIZED (SELECT e.doc_id, e.type_id, e.term_id, e.cnt, sum(g.et * b.eb) + {eps!r} AS phinorm "
            f"FROM {entries} e JOIN {prev} g ON e.doc_id = g.doc_id JOIN {eb} b ON b.type_id = e.type_id AND b.term_id = e.term_id "
            f"AND b.topic = g.topic WHERE NOT g.done GROUP BY 1, 2, 3, 4)",
            f"{t}s{r} AS (SELECT p.doc_id, b.topic, sum(p.cnt / p.phinorm * b.eb) AS s FROM {t}ph{r} p JOIN {eb} b "
            f"ON b.type_id = p.type_id AND b.term_id = p.term_id GROUP BY 1, 2)",
            f"{t}n{r} AS (SELECT g.doc_id, g.topic, CASE WHEN g.done THEN g.gamma ELSE a.alpha + g.et * coalesce(s.s, 0.0) / {num_types}.0 END AS gamma, "
            f"g.gamma AS old, g.done, g.iters FROM {prev} g JOIN {t}alpha a ON a.topic = g.topic "
            f"LEFT JOIN {t}s{r} s ON s.doc_id = g.doc_id AND s.topic = g.topic)",
            f"{t}c{r} AS (SELECT doc_id, sum(gamma) AS gs, avg(abs(gamma - old)) AS ch FROM {t}n{r} GROUP BY 1)",
            f"{t}g{r} AS MATERIALIZED (SELECT n.doc_id, n.topic, n.gamma, exp({psi('n.gamma')} - {psi('c.gs')}) AS et, "
            f"(n.done OR c.ch < {thr!r}) AS done, n.iters + CASE WHEN n.done THEN 0 ELSE 1 END AS iters "
            f"FROM {t}n{r} n JOIN {t}c{r} c ON n.doc_id = c.doc_id)",
        ]
    last = f"{t}g{rounds}"
    c += [
        f"{t}gf AS (SELECT * FROM {last})",
        f"{t}phf AS MATERIALIZED (SELECT e.doc_id, e.type_id, e.term_id, e.cnt, sum(g.et * b.eb) + {eps!r} AS phinorm "
        f"FROM {entries} e JOIN {last} g ON e.doc_id = g.doc_id JOIN {eb} b ON b.type_id = e.type_id AND b.term_id = e.term_id "
        f"AND b.topic = g.topic GROUP BY 1, 2, 3, 4)",
        f"{t}sst AS (SELECT p.type_id, p.term_id, g.topic, sum(g.et * p.cnt / p.phinorm * b.eb) AS sstat FROM {t}phf p "
        f"JOIN {t}gf g ON g.doc_id = p.doc_id JOIN {eb} b ON b.type_id = p.type_id AND b.term_id = p.term_id AND b.topic = g.topic "
        f"GROUP BY 1, 2, 3)",
    ]
    return c


__all__ = ["with_", "rnd", "psi", "lgamma_sql", "trigamma_sql", "purchases_terms", "conversation_terms", "text_terms",
           "vocab_entries", "model_ctes", "estep_ctes"]


# ============================================================ query texts
K = 5
ITER = 50
THR = 1e-3
EPS = 1.1920928955078125e-07
CHUNK = 500
T = 3

PV = purchases_terms() + vocab_entries()
PM = PV + model_ctes(K)
PE = PM + estep_ctes(K, T, ITER, THR, EPS)


def _long_sql(src: str, val: str, name: str, keys: str, d: int = 6) -> str:
    return f"SELECT {keys}, topic, {rnd(val, d)} AS {name} FROM {src}"


ORACLE: dict[str, str] = {
    "corpus_purchases": with_(purchases_terms(), f"SELECT doc_id, type_id, term, {rnd('cnt')} AS cnt FROM terms"),
    "corpus_conversations": with_(conversation_terms(), f"SELECT doc_id, type_id, term, {rnd('cnt')} AS cnt FROM terms"),
    "corpus_text": with_(text_terms(), f"SELECT doc_id, type_id, term, {rnd('cnt')} AS cnt FROM terms"),
    "corpus_from_vectors": with_(
        text_terms() + vocab_entries(),
        f"SELECT doc_id, type_id, CAST(term_id AS VARCHAR) AS term, {rnd('cnt')} AS cnt FROM entries WHERE type_id = 0",
    ),
    "vocabulary": with_(PV, f"SELECT type_id, term_id, term, doc_freq, {rnd('coll_freq')} AS coll_freq FROM vocab"),
    "num_terms": with_(PV, "SELECT type_id, count(*)::BIGINT AS num_terms FROM vocab GROUP BY 1"),
    "corpus_size": with_(
        PV,
        f"SELECT type_id, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_rows, {rnd('sum(cnt)')} AS n_tokens "
        "FROM entries GROUP BY 1",
    ),
    "chunk_assignment": with_(
        PV,
        f"SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_index, "
        f"((row_number() OVER (ORDER BY doc_id) - 1) // {CHUNK})::BIGINT AS chunk_id FROM (SELECT DISTINCT doc_id FROM entries)",
    ),
    "doc_lengths": with_(PV, f"SELECT doc_id, {rnd('sum(cnt)')} AS doc_length FROM entries GROUP BY 1"),
    "term_frequency": with_(
        PV,
        f"SELECT v.type_id, v.term_id, v.term, {rnd('CASE WHEN coalesce(f.f, 0) = 0 THEN 0.01 ELSE f.f END')} AS term_frequency "
        "FROM vocab v LEFT JOIN (SELECT type_id, term, sum(cnt) AS f FROM terms GROUP BY 1, 2) f ON f.type_id = v.type_id AND f.term = v.term",
    ),
    "topic_lambda": with_(PM, _long_sql("lam", "lam", "lam", "type_id, term_id")),
    "topic_term_dists": with_(
        PM, f"SELECT l.type_id, l.term_id, l.topic, {rnd('l.lam / m.mass', 8)} AS p FROM lam l JOIN mass m ON l.type_id = m.type_id AND l.topic = m.topic"
    ),
    "elogbeta": with_(PM, _long_sql("elog", "elogbeta", "elogbeta", "type_id, term_id")),
    "exp_elogbeta": with_(PM, _long_sql("eb", "eb", "eb", "type_id, term_id", 8)),
    "topic_mass": with_(PM, f"SELECT type_id, topic, {rnd('mass')} AS mass FROM mass"),
    "estep_gamma": with_(PE, f"SELECT doc_id, topic, {rnd('gamma', 4)} AS gamma FROM gf"),
    "doc_topics": with_(
        PE,
        f"SELECT doc_id, topic, {rnd('p')} AS p FROM (SELECT doc_id, topic, gamma / sum(gamma) OVER (PARTITION BY doc_id) AS p FROM gf) "
        "WHERE p >= 0.01",
    ),
    "sstats_estep": with_(PE, f"SELECT type_id, term_id, topic, {rnd('sstat', 4)} AS sstat FROM sst"),
    "estep_convergence": with_(
        PE,
        "SELECT count(*)::BIGINT AS n_docs, sum(CASE WHEN done THEN 1 ELSE 0 END)::BIGINT AS n_converged, "
        "sum(iters)::BIGINT AS total_iters FROM (SELECT DISTINCT doc_id, done, iters FROM gf)",
    ),
    "phinorm": with_(
        PM,
        f"SELECT e.doc_id, e.type_id, e.term_id, {rnd(f'sum(b.eb) * {float(np.exp(digamma_np(1.0) - digamma_np(float(K))))!r} + {EPS!r}', 8)} AS phinorm "
        "FROM entries e JOIN eb b ON b.type_id = e.type_id AND b.term_id = e.term_id GROUP BY 1, 2, 3",
    ),
}


# ------------------------------------------------------------ wave 2
def _ab() -> list[str]:
    return PV + assign_ctes(K) + derive_ctes() + assign_ctes(K, rule="div", prefix="b_")


def _newton_alpha_sql(rho: float = 1.0) -> str:
    """One Newton step of alpha from the E step of model A (driver values
    in the engine, plain SQL here)."""
    return (
        "gs AS (SELECT doc_id, sum(gamma) AS gs FROM gf GROUP BY 1), "
        f"lp AS (SELECT g.topic, avg({psi('g.gamma')} - {psi('s.gs')}) AS logphat, count(*)::DOUBLE AS n "
        "FROM gf g JOIN gs s ON s.doc_id = g.doc_id GROUP BY 1), "
        "asum AS (SELECT sum(alpha) AS sa FROM alpha), "
        f"nw AS (SELECT l.topic, a.alpha, l.n * ({psi('x.sa')} - {psi('a.alpha')} + l.logphat) AS g, "
        f"-l.n * {trigamma_sql('a.alpha')} AS q, l.n * {trigamma_sql('x.sa')} AS c "
        "FROM lp l JOIN alpha a ON a.topic = l.topic CROSS JOIN asum x), "
        "bb AS (SELECT sum(g / q) / (1.0 / max(c) + sum(1.0 / q)) AS b FROM nw), "
        f"upd AS (SELECT n.topic, n.alpha + {rho!r} * (-(n.g - bb.b) / n.q) AS na, n.alpha FROM nw n CROSS JOIN bb)"
    )


_ETA_NEWTON = (
    "lp AS (SELECT type_id, term_id, avg(elogbeta) AS logphat FROM elog GROUP BY 1, 2), "
    "base AS (SELECT l.type_id, l.term_id, l.logphat, s.eta0 AS eta FROM lp l JOIN (SELECT DISTINCT type_id, term_id, eta0 FROM st) s "
    "ON s.type_id = l.type_id AND s.term_id = l.term_id), "
    "tot AS (SELECT type_id, sum(eta) AS se FROM base GROUP BY 1), "
    f"x AS (SELECT b.*, {K}.0 * ({psi('t.se')} - {psi('b.eta')} + b.logphat) AS g, -{K}.0 * {trigamma_sql('b.eta')} AS q, "
    f"{K}.0 * {trigamma_sql('t.se')} AS c FROM base b JOIN tot t ON t.type_id = b.type_id), "
    "bb AS (SELECT type_id, sum(g / q) / (1.0 / max(c) + sum(1.0 / q)) AS b FROM x GROUP BY 1), "
    "y AS (SELECT x.type_id, x.term_id, x.eta, x.eta + 1.0 * (-(x.g - bb.b) / x.q) AS upd FROM x JOIN bb ON bb.type_id = x.type_id), "
    "ok AS (SELECT type_id, min(upd) > 0 AS ok FROM y GROUP BY 1)"
)

_DOC_BOUND = [
    "phd AS (SELECT e.doc_id, e.type_id, e.term_id, e.cnt, sum(g.et * b.eb) AS dot FROM entries e JOIN gf g ON g.doc_id = e.doc_id "
    "JOIN eb b ON b.type_id = e.type_id AND b.term_id = e.term_id AND b.topic = g.topic GROUP BY 1, 2, 3, 4)",
    "ll AS (SELECT doc_id, sum(cnt * ln(dot)) AS ll FROM phd GROUP BY 1)",
    "gs AS (SELECT doc_id, sum(gamma) AS gs FROM gf GROUP BY 1)",
    f"tp AS (SELECT g.doc_id, sum((a.alpha - g.gamma) * ({psi('g.gamma')} - {psi('s.gs')})) + sum(lgamma(g.gamma) - lgamma(a.alpha)) "
    "+ lgamma(sum(a.alpha)) - lgamma(sum(g.gamma)) AS tp FROM gf g JOIN alpha a ON a.topic = g.topic JOIN gs s ON s.doc_id = g.doc_id GROUP BY 1)",
    "docb AS (SELECT t.doc_id, t.tp + coalesce(l.ll, 0.0) AS score FROM tp t LEFT JOIN ll l ON l.doc_id = t.doc_id)",
    "bp AS (SELECT sum((l.eta0 - l.lam) * e.elogbeta + lgamma(l.lam) - lgamma(l.eta0)) AS bp FROM lam l JOIN elog e "
    "ON e.type_id = l.type_id AND e.term_id = l.term_id AND e.topic = l.topic)",
    f"bt AS (SELECT sum(x.kl) AS bt FROM (SELECT m.type_id, {K}.0 * lgamma(max(w.se)) - sum(lgamma(m.mass)) AS kl FROM mass m JOIN "
    "(SELECT type_id, sum(eta0) AS se FROM (SELECT DISTINCT type_id, term_id, eta0 FROM st) GROUP BY 1) w ON w.type_id = m.type_id GROUP BY 1) x)",
    "tb AS (SELECT (SELECT sum(score) FROM docb) + (SELECT bp FROM bp) + (SELECT bt FROM bt) AS bound)",
]

# documents in doc_id order, cut into two halves of ceil(D / 2)
_HALVES = [
    "dix AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // ceil(count(*) OVER () / 2.0)::BIGINT AS chunk_id "
    "FROM (SELECT DISTINCT doc_id FROM entries))",
    "hv AS (SELECT count(*)::DOUBLE AS d, count(*) FILTER (WHERE chunk_id = 0)::DOUBLE AS n0, count(*) FILTER (WHERE chunk_id = 1)::DOUBLE AS n1 FROM dix)",
    "e0 AS (SELECT e.* FROM entries e JOIN dix d ON d.doc_id = e.doc_id WHERE d.chunk_id = 0)",
    "e1 AS (SELECT e.* FROM entries e JOIN dix d ON d.doc_id = e.doc_id WHERE d.chunk_id = 1)",
]
_AVG_ELOGTHETA = f"avg({psi('g.gamma')} - {psi('s.gs')})"

ORACLE.update(
    {
        "fn_digamma": with_(PM, f"SELECT type_id, term_id, topic, {rnd(psi('lam'), 8)} AS digamma FROM lam"),
        "fn_trigamma": with_(PM, f"SELECT type_id, term_id, topic, {rnd(trigamma_sql('lam'), 8)} AS trigamma FROM lam"),
        "fn_lgamma": with_(PM, f"SELECT type_id, term_id, topic, {rnd('lgamma(lam)', 6)} AS lgamma FROM lam"),
        "state_merge": with_(
            _ab(), f"SELECT a.type_id, a.term_id, a.topic, {rnd('a.s + b.s')} AS s FROM st a JOIN b_st b "
            "ON a.type_id = b.type_id AND a.term_id = b.term_id AND a.topic = b.topic"
        ),
        "state_blend": with_(
            PE, f"SELECT a.type_id, a.term_id, a.topic, {rnd('0.75 * a.s + 0.25 * coalesce(b.sstat, 0.0)', 4)} AS s FROM st a LEFT JOIN sst b "
            "ON a.type_id = b.type_id AND a.term_id = b.term_id AND a.topic = b.topic"
        ),
        "state_blend2": with_(
            PE, f"SELECT a.type_id, a.term_id, a.topic, {rnd('a.s + coalesce(b.sstat, 0.0)', 4)} AS s FROM st a LEFT JOIN sst b "
            "ON a.type_id = b.type_id AND a.term_id = b.term_id AND a.topic = b.topic"
        ),
        "prior_init": with_(
            PM,
            f"SELECT 'eta' AS prior, type_id, term_id AS idx, {rnd('eta0', 8)} AS value FROM (SELECT DISTINCT type_id, term_id, eta0 FROM st) "
            f"UNION ALL SELECT 'alpha', -1, topic, {rnd(f'(1.0 / (topic + sqrt({K}))) / (SELECT sum(1.0 / (range + sqrt({K}))) FROM range({K}))', 8)} FROM topics",
        ),
        "alpha_logphat": with_(
            PE + ["gs AS (SELECT doc_id, sum(gamma) AS gs FROM gf GROUP BY 1)"],
            f"SELECT g.topic, {rnd(_AVG_ELOGTHETA, 8)} AS logphat "
            "FROM gf g JOIN gs s ON s.doc_id = g.doc_id GROUP BY 1",
        ),
        "alpha_update": with_(
            PE + [_newton_alpha_sql(1.0)],
            f"SELECT topic, {rnd('CASE WHEN (SELECT min(na) FROM upd) > 0 THEN na ELSE alpha END', 8)} AS alpha FROM upd",
        ),
        "eta_logphat": with_(PM, f"SELECT type_id, term_id, {rnd('avg(elogbeta)', 8)} AS logphat FROM elog GROUP BY 1, 2"),
        "eta_newton": with_(
            PM + [_ETA_NEWTON],
            f"SELECT y.type_id, y.term_id, {rnd('CASE WHEN ok.ok THEN y.upd ELSE y.eta END', 8)} AS eta FROM y JOIN ok ON ok.type_id = y.type_id",
        ),
        "learning_rate": with_(
            PV
            + [
                f"ch AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // {CHUNK} AS chunk_id FROM (SELECT DISTINCT doc_id FROM entries))",
                "cs AS (SELECT chunk_id, count(*) AS n FROM ch GROUP BY 1)",
                "cum AS (SELECT chunk_id, coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
                "sum(n) OVER () AS total FROM cs)",
            ],
            f"SELECT p.range::INT AS pass, chunk_id::INT AS update_no, {rnd(f'pow(1.0 + p.range + (CASE WHEN p.range = 0 THEN before ELSE total END) / {CHUNK}, -0.5)', 8)} AS rho "
            "FROM cum CROSS JOIN range(2) p",
        ),
        "mstep_lambda": with_(
            PE + mstep_ctes("", "m1_", "sst", 0.5, 1.0), f"SELECT type_id, term_id, topic, {rnd('lam', 4)} AS lam FROM m1_lam"
        ),
        "mstep_topic_diff": with_(
            PE + mstep_ctes("", "m1_", "sst", 0.5, 1.0),
            f"SELECT {rnd('avg(d)', 8)} AS topic_diff FROM (SELECT a.type_id, avg(abs(a.elogbeta - b.elogbeta)) AS d FROM elog a JOIN m1_elog b "
            "ON a.type_id = b.type_id AND a.term_id = b.term_id AND a.topic = b.topic GROUP BY 1)",
        ),
        "train_batch_1pass": with_(
            PE + mstep_ctes("", "m1_", "sst", 0.0, 1.0), f"SELECT type_id, term_id, topic, {rnd('s', 4)} AS s FROM m1_st"
        ),
        "train_online_2chunks": with_(
            PM + _HALVES
            + estep_ctes(K, T, ITER, THR, EPS, tag="a_", entries="e0")
            + mstep_ctes("", "m1_", "a_sst", 0.0, "(SELECT d / n0 FROM hv)")
            + estep_ctes(K, T, ITER, THR, EPS, tag="b_", entries="e1", eb="m1_eb")
            + mstep_ctes("m1_", "m2_", "b_sst", "(SELECT CASE WHEN n1 > 0 THEN 1.0 - pow(2.0, -0.5) ELSE 1.0 END FROM hv)",
                         "(SELECT CASE WHEN n1 > 0 THEN pow(2.0, -0.5) * d / n1 ELSE 0.0 END FROM hv)"),
            f"SELECT type_id, term_id, topic, {rnd('s', 4)} AS s FROM m2_st",
        ),
        "train_incremental": with_(
            PM + _HALVES
            + estep_ctes(K, T, ITER, THR, EPS, tag="a_", entries="e0")
            + mstep_ctes("", "m1_", "a_sst", 0.0, 1.0)
            + estep_ctes(K, T, ITER, THR, EPS, tag="b_", entries="e1", eb="m1_eb")
            + mstep_ctes("m1_", "m2_", "b_sst", "(SELECT CASE WHEN n1 > 0 THEN 1.0 - pow(1.0 + n0 / least(n1, 2000), -0.5) ELSE 1.0 END FROM hv)",
                         "(SELECT CASE WHEN n1 > 0 THEN pow(1.0 + n0 / least(n1, 2000), -0.5) * d / n1 ELSE 0.0 END FROM hv)"),
            f"SELECT type_id, term_id, topic, {rnd('s', 4)} AS s FROM m2_st",
        ),
        "train_incremental_chunksize": with_(
            PM + _HALVES
            + estep_ctes(K, T, ITER, THR, EPS, tag="a_", entries="e0")
            + mstep_ctes("", "m1_", "a_sst", 0.0, 1.0)
            + estep_ctes(K, T, ITER, THR, EPS, tag="b_", entries="e1", eb="m1_eb")
            + mstep_ctes("m1_", "m2_", "b_sst", "(SELECT CASE WHEN n1 > 0 THEN 1.0 - pow(1.0 + n0 / 100000.0, -0.5) ELSE 1.0 END FROM hv)",
                         "(SELECT CASE WHEN n1 > 0 THEN pow(1.0 + n0 / 100000.0, -0.5) * d / n1 ELSE 0.0 END FROM hv)"),
            f"SELECT type_id, term_id, topic, {rnd('s', 4)} AS s FROM m2_st",
        ),
        "state_init": with_(
            PV + [f"topics AS (SELECT range::INT AS topic FROM range({K}))",
                  "u AS (SELECT v.type_id, v.term_id, t.topic, "
                  + ", ".join(f"(('0x' || substring(md5(concat_ws(':', 7, {salt}, v.type_id, v.term_id, t.topic)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u{salt}" for salt in (1, 2))
                  + " FROM vocab v CROSS JOIN topics t)",
                  "z AS (SELECT *, sqrt(-2.0 * ln(u1)) * cos(2.0 * pi() * u2) AS z FROM u)"],
            f"SELECT type_id, term_id, topic, {rnd('greatest(1e-12, pow(1.0 - 1.0 / 900.0 + z * sqrt(1.0 / 900.0), 3))', 8)} AS s FROM z",
        ),
        "eta_table": with_(PM, f"SELECT type_id, term_id, topic, {rnd('s + (term_id + 1) / 10.0')} AS lam FROM st"),
        "log_perplexity_ratio": with_(
            PE + _DOC_BOUND + ["wd AS (SELECT sum(cnt) AS w FROM entries)"],
            f"SELECT {rnd('(2.0 * (SELECT sum(score) FROM docb) + (SELECT bp FROM bp) + (SELECT bt FROM bt)) / (2.0 * (SELECT w FROM wd))', 8)} AS perwordbound",
        ),
        "bound_gamma_supplied": with_(
            PM + [f"alpha AS (SELECT topic, 1.0 / {K} AS alpha FROM topics)",
                  "gf AS (SELECT d.doc_id, t.topic, coalesce(c.g, 0.0) + 1.0 AS gamma FROM (SELECT DISTINCT doc_id FROM entries) d CROSS JOIN topics t "
                  f"LEFT JOIN (SELECT doc_id, term_id % {K} AS topic, sum(cnt) AS g FROM entries GROUP BY 1, 2) c ON c.doc_id = d.doc_id AND c.topic = t.topic)",
                  f"el AS (SELECT g.doc_id, g.topic, {psi('g.gamma')} - {psi('s.gs')} AS e FROM gf g JOIN (SELECT doc_id, sum(gamma) AS gs FROM gf GROUP BY 1) s ON s.doc_id = g.doc_id)",
                  "vv AS (SELECT e.doc_id, e.type_id, e.term_id, e.cnt, l.e + b.elogbeta AS v FROM entries e JOIN el l ON l.doc_id = e.doc_id "
                  "JOIN elog b ON b.type_id = e.type_id AND b.term_id = e.term_id AND b.topic = l.topic)",
                  "mx AS (SELECT doc_id, type_id, term_id, max(v) AS m FROM vv GROUP BY 1, 2, 3)",
                  "lw AS (SELECT sum(x.cnt * x.lse) AS ll FROM (SELECT v.cnt, m.m + ln(sum(exp(v.v - m.m))) AS lse FROM vv v JOIN mx m ON m.doc_id = v.doc_id "
                  "AND m.type_id = v.type_id AND m.term_id = v.term_id GROUP BY v.doc_id, v.type_id, v.term_id, v.cnt, m.m) x)"]
            + [c for c in _DOC_BOUND if c.split(" ", 1)[0] in ("gs", "tp", "bp", "bt")],
            f"SELECT {rnd('(SELECT ll FROM lw) + (SELECT sum(tp) FROM tp) + (SELECT bp FROM bp) + (SELECT bt FROM bt)', 3)} AS bound",
        ),
        "bound_docs": with_(PE + _DOC_BOUND, f"SELECT doc_id, {rnd('score', 4)} AS score FROM docb"),
        "bound": with_(PE + _DOC_BOUND, f"SELECT {rnd('bound', 3)} AS bound FROM tb"),
        "log_perplexity": with_(
            PE + _DOC_BOUND + ["wd AS (SELECT sum(cnt) AS w, count(DISTINCT doc_id)::BIGINT AS n FROM entries)"],
            f"SELECT {rnd('tb.bound / wd.w', 8)} AS perwordbound, {rnd('pow(2.0, -(tb.bound / wd.w))', 6)} AS perplexity, wd.n AS n_docs, "
            f"{rnd('wd.w', 4)} AS n_words FROM tb CROSS JOIN wd",
        ),
    }
)


# ------------------------------------------------------------ wave 3: topics and comparison
_P = ["pa AS (SELECT l.type_id, l.term_id, l.topic, l.lam / m.mass AS p FROM lam l JOIN mass m ON m.type_id = l.type_id AND m.topic = l.topic)"]
_TOPN = (
    "tt AS (SELECT topic, type_id, term_id, p, row_number() OVER (PARTITION BY topic, type_id ORDER BY p DESC, term_id ASC) AS rank FROM pa)"
)
_TW = "tw AS (SELECT t.topic, t.type_id, t.rank, v.term, t.p FROM tt t JOIN vocab v ON v.type_id = t.type_id AND v.term_id = t.term_id WHERE t.rank <= 10)"
_AB_P = (
    PV + assign_ctes(K) + derive_ctes() + assign_ctes(K, rule="div", prefix="b_") + derive_ctes("b_") + _P
    + ["pb AS (SELECT l.type_id, l.term_id, l.topic, l.lam / m.mass AS p FROM b_lam l JOIN b_mass m ON m.type_id = l.type_id AND m.topic = l.topic)",
       "psa AS (SELECT topic, sum(p) AS s FROM pa GROUP BY 1)", "psb AS (SELECT topic, sum(p) AS s FROM pb GROUP BY 1)",
       "pr AS MATERIALIZED (SELECT a.topic AS topic1, b.topic AS topic2, a.p AS p, b.p AS q, x.s AS sp, y.s AS sq FROM pa a JOIN pb b "
       "ON a.type_id = b.type_id AND a.term_id = b.term_id JOIN psa x ON x.topic = a.topic JOIN psb y ON y.topic = b.topic)",
       "ws_a AS (SELECT topic, list_sort(list(DISTINCT term)) AS w FROM (SELECT t.topic, v.term FROM (SELECT topic, type_id, term_id, "
       "row_number() OVER (PARTITION BY topic, type_id ORDER BY p DESC, term_id ASC) AS rank FROM pa) t JOIN vocab v ON v.type_id = t.type_id "
       "AND v.term_id = t.term_id WHERE t.rank <= 30) GROUP BY 1)",
       "ws_b AS (SELECT topic, list_sort(list(DISTINCT term)) AS w FROM (SELECT t.topic, v.term FROM (SELECT topic, type_id, term_id, "
       "row_number() OVER (PARTITION BY topic, type_id ORDER BY p DESC, term_id ASC) AS rank FROM pb) t JOIN vocab v ON v.type_id = t.type_id "
       "AND v.term_id = t.term_id WHERE t.rank <= 30) GROUP BY 1)"]
)


def _normed(zsql: str, d: int = 6) -> str:
    return (f"SELECT topic1, topic2, {rnd('CASE WHEN abs(mx) > 1e-8 THEN z / mx ELSE z END', d)} AS z FROM "
            f"(SELECT *, max(z) OVER () AS mx FROM ({zsql}))")


_KL = "SELECT topic1, topic2, sum((p / sp) * ln((p / sp) / (q / sq))) AS z FROM pr GROUP BY 1, 2"
_HEL = "SELECT topic1, topic2, sqrt(0.5 * sum(pow(sqrt(p) - sqrt(q), 2))) AS z FROM pr GROUP BY 1, 2"
_JS = (
    "SELECT topic1, topic2, 0.5 * sum((p / sp) * ln((p / sp) / ((p + q) / (sp + sq))) + (q / sq) * ln((q / sq) / ((p + q) / (sp + sq)))) AS z "
    "FROM pr GROUP BY 1, 2"
)
_JAC = (
    "SELECT a.topic AS topic1, b.topic AS topic2, CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1.0 "
    "ELSE 1.0 - len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS z FROM ws_a a CROSS JOIN ws_b b"
)
_RDOT = (
    "SELECT d.topic1, d.topic2, (d.dot - mn.d) / (mx.d - mn.d) AS z FROM (SELECT topic1, topic2, sum(p * q) AS dot FROM pr GROUP BY 1, 2) d "
    "JOIN (SELECT a.topic AS topic1, b.topic AS topic2, sum(a.p * b.p) AS d FROM ra a JOIN rb b ON a.r = b.r GROUP BY 1, 2) mx "
    "ON mx.topic1 = d.topic1 AND mx.topic2 = d.topic2 "
    "JOIN (SELECT a.topic AS topic1, b.topic AS topic2, sum(a.p * b.p) AS d FROM ra a CROSS JOIN nw JOIN rb b ON a.r = nw.n - 1 - b.r GROUP BY 1, 2) mn "
    "ON mn.topic1 = d.topic1 AND mn.topic2 = d.topic2"
)
_RANKS = [
    "ra AS (SELECT topic, p, row_number() OVER (PARTITION BY topic ORDER BY p) - 1 AS r FROM pa)",
    "rb AS (SELECT topic, p, row_number() OVER (PARTITION BY topic ORDER BY p) - 1 AS r FROM pb)",
    "nw AS (SELECT count(*) AS n FROM vocab)",
]

ORACLE.update(
    {
        "topic_terms": with_(PM + _P + [_TOPN], f"SELECT topic, type_id, rank::INT AS rank, term_id, {rnd('p', 8)} AS p FROM tt WHERE rank <= 10"),
        "show_topic": with_(PM + _P + [_TOPN, _TW], f"SELECT topic, type_id, rank::INT AS rank, term, {rnd('p', 8)} AS p FROM tw WHERE topic = 0"),
        "show_topics": with_(PM + _P + [_TOPN, _TW], f"SELECT topic, type_id, rank::INT AS rank, term, {rnd('p', 8)} AS p FROM tw"),
        "show_topics_formatted": with_(
            PM + _P + [_TOPN, _TW],
            "SELECT topic, type_id, string_agg(printf('%.3f*\"%s\"', p, term), ' + ' ORDER BY rank) AS repr FROM tw GROUP BY 1, 2",
        ),
        "show_topics_subset": with_(
            PM + _P + [_TOPN, _TW, f"al AS (SELECT topic, row_number() OVER (ORDER BY {1.0 / K!r}, topic) AS r FROM topics)"],
            f"SELECT t.topic, t.type_id, t.rank::INT AS rank, t.term, {rnd('t.p', 8)} AS p FROM tw t JOIN al a ON a.topic = t.topic "
            f"WHERE a.r <= 3 // 2 OR a.r > {K} - (3 + 1) // 2",
        ),
        "term_topics": with_(PM, f"SELECT type_id, term_id, topic, {rnd('eb', 8)} AS value FROM eb WHERE eb >= 0.01"),
        "word_phi": with_(
            PE,
            f"SELECT p.doc_id, p.type_id, p.term_id, g.topic, {rnd('g.et * p.cnt / p.phinorm * b.eb', 4)} AS nphi FROM phf p "
            "JOIN gf g ON g.doc_id = p.doc_id JOIN eb b ON b.type_id = p.type_id AND b.term_id = p.term_id AND b.topic = g.topic "
            "WHERE g.et * p.cnt / p.phinorm * b.eb >= 0.01",
        ),
        "word_topics": with_(
            PE,
            "SELECT doc_id, type_id, term_id, row_number() OVER (PARTITION BY doc_id, type_id, term_id ORDER BY nphi DESC, topic DESC)::INT AS rank, "
            "topic FROM (SELECT p.doc_id, p.type_id, p.term_id, g.topic, g.et * p.cnt / p.phinorm * b.eb AS nphi FROM phf p "
            "JOIN gf g ON g.doc_id = p.doc_id JOIN eb b ON b.type_id = p.type_id AND b.term_id = p.term_id AND b.topic = g.topic) "
            "WHERE nphi >= 0.01",
        ),
        "topic_wordset": with_(_AB_P, "SELECT topic, array_to_string(w, '|') AS words FROM ws_a"),
        "topic_diff_kl": with_(_AB_P, _normed(_KL)),
        "topic_diff_hellinger": with_(_AB_P, _normed(_HEL)),
        "topic_diff_self_hellinger": with_(
            PM + _P,
            f"SELECT topic1, topic2, {rnd('z / max(z) OVER ()')} AS z, true AS exact FROM (SELECT a.topic AS topic1, b.topic AS topic2, "
            "sqrt(0.5 * sum(pow(sqrt(a.p) - sqrt(b.p), 2))) AS z FROM pa a JOIN pa b ON a.type_id = b.type_id AND a.term_id = b.term_id GROUP BY 1, 2)",
        ),
        "topic_diff_jaccard": with_(_AB_P, _normed(_JAC)),
        "topic_diff_js": with_(_AB_P, _normed(_JS)),
        "topic_diff_rescaled_dot": with_(_AB_P + _RANKS, _normed(_RDOT)),
        "topic_diff_diagonal": with_(_AB_P, _normed(_KL.replace("FROM pr GROUP BY", "FROM pr WHERE topic1 = topic2 GROUP BY"))),
        "topic_diff_annotation": with_(
            _AB_P,
            f"SELECT h.topic1, h.topic2, {rnd('h.z')} AS z, array_to_string(list_sort(list_intersect(a.w, b.w))[1:10], '|') AS pos, "
            "array_to_string(list_sort(list_concat(list_filter(a.w, lambda x: NOT list_contains(b.w, x)), "
            "list_filter(b.w, lambda x: NOT list_contains(a.w, x))))[1:10], '|') AS neg "
            f"FROM ({_HEL}) h JOIN ws_a a ON a.topic = h.topic1 JOIN ws_b b ON b.topic = h.topic2",
        ),
    }
)


# ------------------------------------------------------------ wave 4: visualisation, persistence, streaming
_TP = [
    "gs2 AS (SELECT doc_id, sum(gamma) AS gs FROM gf GROUP BY 1)",
    "th AS (SELECT g.doc_id, g.topic, g.gamma / s.gs AS theta FROM gf g JOIN gs2 s ON s.doc_id = g.doc_id)",
    "dl AS (SELECT doc_id, sum(cnt) AS doc_length FROM entries GROUP BY 1)",
    "tfq AS (SELECT t.topic, sum(t.theta * d.doc_length) AS topic_freq FROM th t JOIN dl d ON d.doc_id = t.doc_id GROUP BY 1)",
    "tp AS (SELECT topic, topic_freq, topic_freq / sum(topic_freq) OVER () AS proportion, "
    "row_number() OVER (ORDER BY topic_freq DESC, topic ASC) AS ord FROM tfq)",
    f"ttj AS (SELECT l.topic, l.type_id, l.term_id, l.lam / m.mass / {T}.0 AS pj FROM lam l JOIN mass m ON m.type_id = l.type_id AND m.topic = l.topic)",
    "tmg AS (SELECT type_id, term_id, freq, freq / sum(freq) OVER () AS p_w FROM (SELECT t.type_id, t.term_id, sum(t.pj * p.topic_freq) AS freq "
    "FROM ttj t JOIN tp p ON p.topic = t.topic GROUP BY 1, 2))",
]

_UD_TERMS = [
    "ev AS (SELECT user_id::BIGINT * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS doc_id, event_type, value FROM events)",
    "terms AS (SELECT doc_id, 0 AS type_id, event_type AS term, count(*)::DOUBLE AS cnt FROM ev WHERE event_type IS NOT NULL GROUP BY 1, 2, 3 "
    "UNION ALL SELECT doc_id, 1, 'v' || floor(value / 100)::BIGINT::VARCHAR, count(*)::DOUBLE FROM ev WHERE value IS NOT NULL GROUP BY 1, 2, 3)",
]

ORACLE.update(
    {
        "vis_topic_term": with_(
            PM,
            f"SELECT l.topic, l.type_id, l.term_id, {rnd('l.lam / m.mass', 8)} AS p, {rnd(f'l.lam / m.mass / {T}.0', 8)} AS p_joint "
            "FROM lam l JOIN mass m ON m.type_id = l.type_id AND m.topic = l.topic",
        ),
        "vis_doc_topic": with_(PE + _TP, f"SELECT doc_id, topic, {rnd('theta')} AS theta FROM th"),
        "doc_topic_dists_supplied": with_(
            PV,
            f"SELECT doc_id, topic, {rnd('w / sum(w) OVER (PARTITION BY doc_id)', 8)} AS theta FROM "
            f"(SELECT doc_id, ((term_id % {K}) + {K}) % {K} AS topic, sum(cnt) AS w FROM entries GROUP BY 1, 2)",
        ),
        "vis_vocab": with_(PV, "SELECT type_id, term_id, term FROM vocab"),
        "vis_topic_proportion": with_(
            PE + _TP, f"SELECT topic, {rnd('topic_freq', 4)} AS topic_freq, {rnd('proportion', 8)} AS proportion, ord::INT AS \"order\" FROM tp"
        ),
        "vis_saliency": with_(
            PE + _TP + ["cs AS (SELECT type_id, term_id, sum(pj) AS cs FROM ttj GROUP BY 1, 2)"],
            f"SELECT d.type_id, d.term_id, {rnd('d.dist', 8)} AS distinctiveness, {rnd('m.p_w * d.dist', 8)} AS saliency FROM "
            "(SELECT t.type_id, t.term_id, sum((t.pj / c.cs) * ln((t.pj / c.cs) / p.proportion)) AS dist FROM ttj t "
            "JOIN cs c ON c.type_id = t.type_id AND c.term_id = t.term_id JOIN tp p ON p.topic = t.topic GROUP BY 1, 2) d "
            "JOIN tmg m ON m.type_id = d.type_id AND m.term_id = d.term_id",
        ),
        "vis_relevance": with_(
            PE + _TP,
            f"SELECT topic, rank::INT AS rank, type_id, term_id, {rnd('rel')} AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY topic "
            "ORDER BY rel DESC, type_id, term_id) AS rank FROM (SELECT t.topic, t.type_id, t.term_id, 0.6 * ln(t.pj) + 0.4 * ln(t.pj / m.p_w) AS rel "
            "FROM ttj t JOIN tmg m ON m.type_id = t.type_id AND m.term_id = t.term_id)) WHERE rank <= 30",
        ),
        "vis_topic_distance": with_(
            PM + _P + [
                "psa AS (SELECT topic, sum(p) AS s FROM pa GROUP BY 1)",
                "pr AS (SELECT a.topic AS topic1, b.topic AS topic2, a.p AS p, b.p AS q, x.s AS sp, y.s AS sq FROM pa a JOIN pa b "
                "ON a.type_id = b.type_id AND a.term_id = b.term_id JOIN psa x ON x.topic = a.topic JOIN psa y ON y.topic = b.topic)",
            ],
            f"SELECT topic1, topic2, {rnd('z', 8)} AS js FROM ({_JS})",
        ),
        "model_roundtrip": with_(PM, _long_sql("lam", "lam", "lam", "type_id, term_id")),
        "stream_user_days": with_(
            _UD_TERMS + vocab_entries() + model_ctes(K) + estep_ctes(K, 2, ITER, THR, EPS) + mstep_ctes("", "m1_", "sst", 0.0, 1.0),
            f"SELECT type_id, term_id, topic, {rnd('s', 4)} AS s FROM m1_st",
        ),
    }
)


ORACLE.update(
    {
        "estep_text_join": with_(
            text_terms() + vocab_entries() + model_ctes(K) + estep_ctes(K, T, ITER, THR, EPS),
            f"SELECT doc_id, topic, {rnd('p')} AS p FROM (SELECT doc_id, topic, gamma / sum(gamma) OVER (PARTITION BY doc_id) AS p FROM gf) "
            "WHERE p >= 0.01",
        ),
        "estep_hot_docs": ORACLE["estep_gamma"],
        "estep_gamma_random": with_(
            PM + estep_ctes(K, T, ITER, THR, EPS, seed=3), _long_sql("gf", "gamma", "gamma", "doc_id", 4)
        ),
        "merge_many_topics": with_(
            PV + model_ctes(2000) + model_ctes(2000, rule="div", prefix="b_"),
            f"SELECT type_id, topic, {rnd('sum(s)', 5)} AS s FROM (SELECT type_id, topic, s FROM st UNION ALL SELECT type_id, topic, s FROM b_st) "
            "GROUP BY type_id, topic",
        ),
    }
)
ORACLE["stream_closed_days"] = with_(_UD_TERMS, f"SELECT doc_id, type_id, term, {rnd('cnt')} AS cnt FROM terms")
ORACLE["stream_scores"] = ORACLE["doc_topics"]
ORACLE["estimator_pipeline"] = with_(
    PE + mstep_ctes("", "m1_", "sst", 0.0, 1.0) + estep_ctes(K, T, ITER, THR, EPS, tag="b_", eb="m1_eb"),
    f"SELECT doc_id, topic, {rnd('gamma / sum(gamma) OVER (PARTITION BY doc_id)', 4)} AS p FROM b_gf",
)
ORACLE["scored_words"] = ORACLE["word_topics"]
