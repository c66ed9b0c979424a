"""The multi-type topic model: parameters, priors, state versions and the
distributed E step over a corpus (M1-M3, M4-M5, C1-C3, A16-A17)."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import digamma_np
from ..operators import estep as E
from ..operators import state as S
from ..session import materialize
from ..sources.corpus import Corpus, num_terms

log = logging.getLogger(__name__)

# Fixed value: machine epsilon of float32, the reference's default dtype.
FLOAT32_EPS = 1.1920928955078125e-07
#: bytes of hot documents' ids up to which they are broadcast
HOT_ID_BYTES = 4 << 20
#: bytes of the topic-term table up to which the broadcast arrays are derived from one read of the state,
#: and of a window's statistics up to which they are added up on the driver
SMALL_STATE = 8 << 20


@dataclass
class Params:
    k: int = 100
    chunksize: int = 2000
    passes: int = 1
    update_every: int = 1
    decay: float = 0.5
    offset: float = 1.0
    eval_every: int | None = 10
    iterations: int = 50
    gamma_threshold: float = 0.001
    minimum_probability: float = 0.01
    minimum_phi_value: float = 0.01
    per_word_topics: bool = False
    epsilon: float = FLOAT32_EPS
    seed: int = 0
    strategy: str = "auto"  # auto | broadcast | join
    broadcast_limit_bytes: int = 256 << 20
    max_doc_terms: int | None = None  # None -> 64 MB of K-vectors per document
    track_topic_diff: bool = False
    gamma_start: str = "ones"  # ones | random: Gamma(100, 1/100) by (seed, document, topic)

    def doc_limit(self) -> int:
        return self.max_doc_terms if self.max_doc_terms is not None else max(1000, (64 << 20) // (8 * self.k))


def init_alpha(prior, k: int) -> tuple[np.ndarray, bool]:
    """M2 for alpha: 'symmetric' 1/K, 'asymmetric' 1/(i + sqrt K) normalised,
    'auto' (1/K, learnt), scalar, or a K-vector."""
    if prior is None:
        prior = "symmetric"
    if isinstance(prior, str):
        if prior == "symmetric":
            return np.full(k, 1.0 / k), False
        if prior == "asymmetric":
            a = 1.0 / (np.arange(k) + np.sqrt(k))
            return a / a.sum(), False
        if prior == "auto":
            return np.full(k, 1.0 / k), True
        raise ValueError(f"alpha: no rule named '{prior}'")
    if isinstance(prior, (int, float, np.number)):
        return np.full(k, float(prior)), False
    a = np.asarray(prior, dtype=np.float64)
    if a.shape != (k,):
        raise ValueError(f"alpha needs one value per topic ({k}), got an array of shape {a.shape}")
    return a, False


def init_eta(prior, k: int):
    """M2 for eta: 'symmetric' / None -> 1/K, 'auto' -> 1/K learnt, scalar,
    per-type dict {type_id: scalar}, or a DataFrame (type_id, term_id, eta)."""
    if prior is None:
        prior = "symmetric"
    if isinstance(prior, str):
        if prior == "symmetric":
            return 1.0 / k, False
        if prior == "auto":
            return 1.0 / k, True
        if prior == "asymmetric":
            raise ValueError("eta: an asymmetric rule is defined for alpha only")
        raise ValueError(f"eta: no rule named '{prior}'")
    if isinstance(prior, (int, float, np.number)):
        return float(prior), False
    if isinstance(prior, (dict, DataFrame)):
        return prior, False
    raise ValueError("eta must be a scalar, a per-type dict, a DataFrame or a known string")


@dataclass
class Prepared:
    entries: DataFrame  # (doc_id, type_id, term_id, cnt, chunk_id) of the normal documents
    docs: DataFrame | None  # (doc_id, chunk_id) of all normal documents, also empty ones
    nested: DataFrame  # (doc_id, bag, chunk_id)
    hot: DataFrame | None  # (doc_id, chunk_id) of hot documents
    hot_entries: DataFrame | None
    buckets: int = 1  # per chunk, join strategy
    dealt: E.Dealt | None = None  # blocks per training window

    def drop(self) -> None:
        """Delete the tables that were written for this corpus."""
        from ..session import drop_path, source_path

        if self.dealt is not None:
            self.dealt.blocks.unpersist()
        for t in (self.nested, self.hot, self.hot_entries):
            path = source_path(t) if t is not None else None
            if path and "/multitopic/" in path and path.rsplit("/", 1)[1].rsplit("-", 1)[0] in ("nested", "hot-docs", "hot-entries"):
                drop_path(t.sparkSession, path)


@dataclass
class TopicModel:
    spark: SparkSession
    params: Params
    num_terms: list[int]
    vocab: DataFrame
    state: DataFrame
    alpha: np.ndarray
    numdocs: int = 0
    num_updates: int = 0
    optimize_alpha: bool = False
    optimize_eta: bool = False
    eb_from_s: bool = False  # D23: very first E step of a random start uses S alone
    version: int = 0
    metrics: list = field(default_factory=list)
    _eb: DataFrame | None = None
    _eb_bc: object = None
    _el_bc: object = None
    _small: tuple | None = None
    held: tuple | None = None  # (s, eta0, eta) arrays of a small state while it is trained; then ``state`` is older
    _held_version: int = 0
    _scratch: list = field(default_factory=list)  # intermediate tables of the current window
    _owned_state: bool = False  # state written by this model's own M step (may be dropped when superseded)

    # ----------------------------------------------------------- creation
    @classmethod
    def create(
        cls,
        corpus: Corpus,
        k: int = 100,
        alpha="symmetric",
        eta=None,
        init: str = "random",
        assign_rule: str = "mod",
        state: DataFrame | None = None,
        **params,
    ) -> "TopicModel":
        """M1/M3. ``init``: 'random' (Gamma(100, 1/100) draws, first E step
        from S alone as in the reference), 'assign' (deterministic,
        S = counts of documents hashed to topics) or 'given' (``state``)."""
        p = Params(k=k, **params)
        spark = corpus.entries.sparkSession
        sizes = num_terms(corpus.vocab, corpus.num_types)
        a, opt_a = init_alpha(alpha, k)
        e0, opt_e = init_eta(eta, k)
        if init == "random":
            st = S.random_state(corpus.vocab, k, e0, p.seed)
        elif init == "assign":
            st = S.assign_state(corpus.entries, corpus.vocab, k, e0, assign_rule)
        elif init == "given":
            st = state
        else:
            raise ValueError(f"unknown init '{init}'")
        st = materialize(st, "state")
        return cls(spark, p, sizes, corpus.vocab, st, a, optimize_alpha=opt_a, optimize_eta=opt_e, eb_from_s=(init == "random"))

    @property
    def k(self) -> int:
        return self.params.k

    @property
    def num_types(self) -> int:
        return len(self.num_terms)

    def with_params(self, **kw) -> "TopicModel":
        """A copy with other parameters; it shares the current state, which
        therefore neither copy will delete."""
        self._owned_state = False
        return replace(self, params=replace(self.params, **kw), metrics=list(self.metrics), _scratch=[], _eb=None, _eb_bc=None, _el_bc=None, _small=None, held=None)

    def adopt(self, other: "TopicModel") -> None:
        """Take over another version of this model (state, priors, counts)."""
        self._owned_state = False
        self.new_version(other.state)
        for name in ("alpha", "numdocs", "num_updates", "eb_from_s", "version", "metrics"):
            setattr(self, name, getattr(other, name))

    # ------------------------------------------------------- derived tables
    def lam(self) -> DataFrame:
        return S.lam(self.state)

    def elogbeta(self) -> DataFrame:
        return S.elogbeta(self.lam(), self.k)

    def topic_term_dists(self) -> DataFrame:
        return S.topic_term_dists(self.lam(), self.k)

    def exp_elogbeta(self) -> DataFrame:
        """Exp E[log beta] of the current version, persisted (cache
        refreshed on every new state version, as ``sync_state``)."""
        if self._eb is None:
            src = self.state.select("type_id", "term_id", F.col("s").alias("lam")) if self.eb_from_s else self.lam()
            self._eb = S.exp_elogbeta(S.elogbeta(src, self.k)).persist()
        return self._eb

    def eb_bytes(self) -> int:
        return 8 * self.k * int(sum(self.num_terms))

    def use_broadcast(self) -> bool:
        if self.params.strategy == "broadcast":
            return True
        if self.params.strategy == "join":
            return False
        return self.eb_bytes() <= self.params.broadcast_limit_bytes

    def type_offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.num_terms)[:-1])).astype(np.int64)

    def eb_broadcast(self):
        """The (sum W_t, K) exp E[log beta] array as a broadcast variable; its
        size is K * sum W_t * 8 bytes, checked against the limit first."""
        if self._eb_bc is None:
            small = self.small_arrays()
            self._eb_bc = self.spark.sparkContext.broadcast(self._as_array(self.exp_elogbeta(), "eb") if small is None else small[0])
        return self._eb_bc

    def small_arrays(self) -> tuple[np.ndarray, np.ndarray] | None:
        """exp E[log beta] and E[log beta] of a small state as (sum W_t, K)
        arrays, from one read of it (as many bytes reach the driver as for the
        broadcast of either); None for larger states."""
        if not self.use_broadcast() or self.eb_bytes() > SMALL_STATE:
            return None
        if self._small is None:
            s, eta0, _ = self.held or self._state_arrays()[0]
            types = np.split(np.arange(len(s)), self.type_offsets()[1:])
            elog = lambda lam: np.concatenate([digamma_np(lam[t]) - digamma_np(lam[t].sum(axis=0)) for t in types])
            el = elog(s + eta0[:, None])
            self._small = np.exp(elog(s) if self.eb_from_s else el), el
        return self._small

    def _state_arrays(self) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
        """(s, eta0, eta) of a small state, from one read of it, and its number of terms."""
        self._check_limit()
        tab = self.state.select("type_id", "term_id", "s", "eta0", "eta").toArrow()
        at = self.rows_at(tab)
        n = int(sum(self.num_terms))
        s, eta0, eta = np.zeros((n, self.k)), np.zeros(n), np.zeros(n)
        s[at] = E.vectors_of(tab.select(["s"]).rename_columns(["vec"]), self.k)
        eta0[at], eta[at] = tab.column("eta0").to_numpy(), tab.column("eta").to_numpy()
        return (s, eta0, eta), len(np.unique(at))

    def rows_at(self, tab: pa.Table) -> np.ndarray:
        """Where the terms of a table stand in the (sum W_t, K) arrays."""
        return self.type_offsets()[tab.column("type_id").to_numpy().astype(np.int64)] + tab.column("term_id").to_numpy().astype(np.int64)

    def hold(self) -> bool:
        """Keep a small state as arrays on the driver until :meth:`release`: updates
        then write no version each. A state without a row for every term is not held."""
        if self.held is None and not self.optimize_eta and self.use_broadcast() and self.eb_bytes() <= SMALL_STATE:
            arrays, n = self._state_arrays()
            if n == sum(self.num_terms):
                self.held, self._held_version = arrays, self.version
        return self.held is not None

    def new_arrays(self, s: np.ndarray) -> None:
        """Install a new version of the held state."""
        self.held = (s, *self.held[1:])
        self._drop_caches()
        self.version += 1
        self.eb_from_s = False

    def release(self) -> None:
        """Write a held state, if it has changed, as the model's state."""
        if self.held is None:
            return
        s, eta0, eta = self.held
        if self.version != self._held_version:
            types = np.repeat(np.arange(self.num_types, dtype=np.int32), self.num_terms)
            terms = np.concatenate([np.arange(n, dtype=np.int32) for n in self.num_terms])
            cols = {"type_id": types, "term_id": terms, "s": pa.array(list(s), pa.list_(pa.float64())), "eta0": eta0, "eta": eta}
            self._install(materialize(self.spark.createDataFrame(pa.table(cols)), "state"), True)
        self.held = None

    def topic_vectors(self, mode: str) -> DataFrame:
        """The per-term vectors a kernel mode needs: ``eb`` for inference and,
        for the bound, ``el`` = E[log beta] of lambda."""
        eb = self.exp_elogbeta()
        if mode != "bound":
            return eb
        return eb.join(self.elogbeta().select("type_id", "term_id", F.col("elogbeta").alias("el")), ["type_id", "term_id"])

    def _check_limit(self) -> None:
        if self.eb_bytes() > self.params.broadcast_limit_bytes:
            raise ValueError("the topic-term table exceeds broadcast_limit_bytes; use strategy 'auto' or 'join'")

    def _as_array(self, table: DataFrame, column: str) -> np.ndarray:
        """(sum W_t, K) array of a per-term vector column, its size checked."""
        self._check_limit()
        tab = table.select("type_id", "term_id", column).toArrow()
        at = self.rows_at(tab)
        arr = np.zeros((int(sum(self.num_terms)), self.k))
        arr[at] = tab.column(column).combine_chunks().flatten().to_numpy().reshape(-1, self.k)
        return arr

    def el_broadcast(self):
        """E[log beta] of lambda as a broadcast variable (bound)."""
        if self._el_bc is None:
            small = self.small_arrays()
            self._el_bc = self.spark.sparkContext.broadcast(self._as_array(self.elogbeta(), "elogbeta") if small is None else small[1])
        return self._el_bc

    def new_version(self, state: DataFrame, owned: bool = False) -> None:
        """Install a new state (already materialised) and drop caches. The
        superseded state and the window's intermediates are deleted when this
        model wrote them itself (never a state shared with another model)."""
        self._install(state, owned)
        self.version += 1
        self.eb_from_s = False

    def _install(self, state: DataFrame, owned: bool) -> None:
        from ..session import drop_path, source_path

        old, old_owned = self.state, self._owned_state
        self.state, self._owned_state = state, owned
        for t in self._scratch:
            p = source_path(t)
            if p:
                drop_path(self.spark, p)
        self._scratch = []
        if old_owned:
            p = source_path(old)
            if p:
                drop_path(self.spark, p)
        self._drop_caches()

    def _drop_caches(self) -> None:
        if self._eb is not None:
            self._eb.unpersist()
        self._eb = None
        if self._eb_bc is not None:
            self._eb_bc.destroy()
        if self._el_bc is not None:
            self._el_bc.destroy()
        self._eb_bc = self._el_bc = self._small = None

    # ------------------------------------------------------------ E step
    def prepare(self, entries: DataFrame, docs: DataFrame | None = None, chunks: DataFrame | None = None,
                reuse: bool = True) -> "Prepared":
        """Split hot documents off, attach ``chunk_id`` (``chunks``:
        ``(doc_id, chunk_id)``) and nest the documents once; everything is
        written to the checkpoint folder so all later E steps reuse it. A
        one-shot E step (``reuse=False``: scoring, per-word topics,
        per-document bound) with the broadcast strategy nests on the fly
        straight into the kernel: no corpus write. The join strategy reads
        the documents twice (their terms, then the kernel) and writes them
        either way, with ids and counts only. Hot documents are written
        either way (their E step iterates)."""
        e = entries.select("doc_id", "type_id", "term_id", "cnt")
        d = docs.select("doc_id") if docs is not None else None

        def in_chunks(df, ids=None):
            if df is None:
                return None
            if chunks is None:
                return df.withColumn("chunk_id", F.lit(0).cast("bigint"))
            c = chunks.select("doc_id", "chunk_id")
            return df.join(c if ids is None else ids(c), "doc_id")

        # hot documents leave before anything is shuffled by document
        hot, size = self.hot_docs(e)
        d = in_chunks(d)
        if hot is not None:
            # at most total_entries / limit ids; broadcast only when their
            # counted size fits the limit, else a shuffle join
            small = hot.count() * 16 <= min(HOT_ID_BYTES, self.params.broadcast_limit_bytes)
            b = F.broadcast if small else (lambda x: x)
            normal = in_chunks(e.join(b(hot), "doc_id", "left_anti"))
            hot_entries = materialize(in_chunks(e.join(b(hot), "doc_id"), lambda c: b(c.join(b(hot), "doc_id", "left_semi"))), "hot-entries")
            hot = materialize(hot_entries.select("doc_id", "parts", "chunk_id").distinct(), "hot-docs")
            d = d.join(b(hot.select("doc_id")), "doc_id", "left_anti") if d is not None else None
        else:
            normal, hot_entries = in_chunks(e), None
        keys, buckets = ("doc_id", "chunk_id"), 1
        if not reuse and self.use_broadcast():
            return Prepared(normal, d, E.nest(normal, d, keys=keys, size=size), hot, hot_entries)
        # the nested table is the one written copy of the corpus; the
        # entry view (token counts) reads it back, no second write
        nested = materialize(E.nest(normal, d, keys=keys, sort_chunks=True, size=size), "nested")
        normal = nested.select("doc_id", "chunk_id", F.explode("bag").alias("_e")).select("doc_id", "_e.type_id", "_e.term_id", "_e.cnt", "chunk_id")
        if not self.use_broadcast():
            size = nested.agg(F.sum(F.size("bag")).alias("n"), F.max("chunk_id").alias("c")).first()
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = E.bucket_count(int(size["n"] or 0), int(size["c"] or 0) + 1, self.k, parts)
        return Prepared(normal, d, nested, hot, hot_entries, buckets)

    def deal(self, prep: "Prepared", every: int, n_chunks: int, sizes: dict[int, int]) -> None:
        """Lay the documents out by training window (``every`` chunks; ``sizes``: entries
        per chunk) and hold the state, where it is small enough for the driver to
        add up the statistics of a window's tasks."""
        wins: dict[int, int] = {}
        for c, n in sizes.items():
            wins[c // every] = wins.get(c // every, 0) + n
        most = max(wins.values(), default=0)
        slices = E.slice_count(most, self.spark.sparkContext.defaultParallelism)
        if prep.hot is not None or slices * self.eb_bytes() > SMALL_STATE or not self.hold():
            return
        nested = prep.nested if self.gamma_draws() is None else prep.nested.withColumn("gamma0", self.gamma_draws())
        prep.dealt = E.deal(nested, every, -(-n_chunks // every), most, slices)
        if prep.dealt is None:
            self.release()

    def hot_terms(self) -> DataFrame | None:
        """Terms in more documents than one reducer's share (join strategy
        skew split); from the vocabulary's doc_freq, computed once."""
        if not hasattr(self, "_hot_terms"):
            from ..operators.skew import hot_keys

            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            h = hot_keys(self.vocab, ["type_id", "term_id"], n)
            self._hot_terms = materialize(h, "hot-terms") if h is not None else None
        return self._hot_terms

    def hot_docs(self, entries: DataFrame) -> tuple[DataFrame | None, int]:
        """Documents with more entries than one task should hold, and the parts
        these are dealt into; at most total_entries / limit documents, so the
        id list has a proven bound. Also the number of all other entries."""
        lim = self.params.doc_limit()
        sizes = entries.groupBy("doc_id").agg(F.count("*").alias("_n"))
        rest, most = sizes.agg(F.sum(F.when(F.col("_n") <= lim, F.col("_n"))), F.max("_n")).first()
        if (most or 0) <= lim:
            return None, int(rest or 0)
        size = E.part_limit(lim, self.k, 0 if self.use_broadcast() else 2)
        parts = F.ceil(F.col("_n") / F.lit(size)).cast("int").alias("parts")
        return materialize(sizes.where(F.col("_n") > lim).select("doc_id", parts), "hot-docs"), int(rest or 0)

    def rows(self, prep: "Prepared", mode: str, lo: int | None = None, hi: int | None = None, min_phi: float = 0.0, chunks=None, scored: bool = False) -> DataFrame:
        """Kernel-union rows (see :mod:`operators.estep`) for the documents of
        ``prep`` whose chunk lies in ``[lo, hi)`` (all when ``lo`` is None) and
        fulfils the condition ``chunks`` on ``chunk_id``, if given. ``scored``: train
        mode gives the bound rows too (broadcast strategy, no hot documents). A
        training window of dealt documents comes as an Arrow table, bound rows per chunk."""
        p = self.params
        if prep.dealt is not None and mode == "train" and lo is not None:
            eb, el = self.small_arrays()
            fn = E.make_kernel(mode, self.alpha, self.num_types, p.iterations, p.gamma_threshold, p.epsilon,
                               E.Given(eb), self.type_offsets(), min_phi, E.Given(el) if scored else None)
            return E.window_rows(prep.dealt, lo, hi, fn)

        def flt(df):
            df = df if lo is None else df.where((F.col("chunk_id") >= lo) & (F.col("chunk_id") < hi))
            return df if chunks is None else df.where(chunks)

        nested = flt(prep.nested)
        if self.gamma_draws() is not None:
            nested = nested.withColumn("gamma0", self.gamma_draws())
        if self.use_broadcast():
            fn = E.make_kernel(mode, self.alpha, self.num_types, p.iterations, p.gamma_threshold, p.epsilon,
                               self.eb_broadcast(), self.type_offsets(), min_phi, self.el_broadcast() if scored or mode == "bound" else None)
            rows = E.run(nested, fn)
        else:
            fn = E.make_kernel(mode, self.alpha, self.num_types, p.iterations, p.gamma_threshold, p.epsilon, min_phi=min_phi)
            rows = E.cogroup(nested, self.topic_vectors(mode), prep.buckets, fn)
        if prep.hot is not None:
            hot = flt(prep.hot).select("doc_id", "parts")
            if hot.limit(1).count():
                he = flt(prep.hot_entries)
                given = {}
                if self.use_broadcast():
                    given = {"eb_bc": self.eb_broadcast(), "el_bc": self.el_broadcast() if mode == "bound" else None, "type_offsets": self.type_offsets()}
                else:
                    from ..operators.skew import split_join

                    row = F.lit(16) + F.size("eb") * F.lit(16)
                    he = materialize(split_join(he, self.topic_vectors(mode), ["type_id", "term_id"], self.hot_terms(), row, p.broadcast_limit_bytes), "hot-entries-eb")
                rows = rows.unionByName(
                    E.hot_estep(he, hot, self.alpha, self.num_types, p.iterations, p.gamma_threshold, p.epsilon, mode,
                                materialize, min_phi=min_phi, start=self.gamma_draws(), **given)
                )
        return rows

    def gamma_draws(self):
        """D3: column of a document's first gamma; None: ones."""
        if self.params.gamma_start not in ("ones", "random"):
            raise ValueError(f"gamma_start: no rule named '{self.params.gamma_start}'")
        return S.gamma_draws("'doc', doc_id", self.k, self.params.seed) if self.params.gamma_start == "random" else None

    def estep_rows(self, entries: DataFrame, mode: str, docs: DataFrame | None = None, min_phi: float = 0.0) -> DataFrame:
        return self.rows(self.prepare(entries, docs, reuse=False), mode, min_phi=min_phi)

    def gamma(self, entries: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """M4: ``(doc_id, gamma, iters, converged)``."""
        r = self.estep_rows(entries, "gamma", docs)
        return r.where(F.col("kind") == E.GAMMA).select("doc_id", F.col("vec").alias("gamma"), "iters", "converged")

    def sstats(self, entries: DataFrame | None = None, prep: "Prepared | None" = None, lo=None, hi=None):
        """M5/A1: summed sufficient statistics ``(type_id, term_id, vec)``
        and the task statistics (sum E[log theta], docs, converged), in one
        kernel pass: the kernel output is written once and read twice."""
        prep = prep if prep is not None else self.prepare(entries)
        if prep.dealt is not None and lo is not None:
            return self._window(self.rows(prep, "train", lo, hi))[:4]
        rows = materialize(self.rows(prep, "train", lo, hi), "estep")
        self._scratch.append(rows)
        ss = E.sum_vectors(rows.where(F.col("kind") == E.SSTATS), ["type_id", "term_id"], self.k)
        # per-task statistics summed on the cluster: one K-vector reaches the driver
        stats = rows.where(F.col("kind") == E.STATS)
        st = stats.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
        elog = [r["vec"] for r in E.sum_vectors(stats, [], self.k).collect()]
        elog = np.array([x or 0.0 for x in elog[0]]) if elog else np.zeros(self.k)
        return ss, elog, int(st["n"] or 0), int(st["m"] or 0)

    def scored_window(self, prep: "Prepared", lo: int, hi: int, due):
        """M5/M13 in one kernel pass and one grouped aggregation: what
        :meth:`sstats` returns, and ``{chunk: (score, documents)}`` of the chunks
        that fulfil ``due``. A row per due chunk and K sums reach the driver; of
        dealt documents the statistics of every task, and the scores of all chunks."""
        if prep.dealt is not None:
            return self._window(self.rows(prep, "train", lo, hi, scored=True))
        rows = materialize(self.rows(prep, "train", lo, hi, scored=True), "estep")
        self._scratch.append(rows)
        ss = E.sum_vectors(rows.where(F.col("kind") == E.SSTATS), ["type_id", "term_id"], self.k)
        chunk = F.when(F.col("kind") == E.BOUND, F.col("n"))
        few = rows.where(F.col("kind").isin(E.STATS, E.BOUND)).select("kind", chunk.alias("chunk_id"), "n", "m", "vec")
        few = few.where((F.col("kind") == E.STATS) | due)
        sums = [F.sum(F.get("vec", F.lit(i))) for i in range(max(2, self.k))]
        got = few.groupBy("kind", "chunk_id").agg(F.array(*sums).alias("vec"), F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("d")).collect()
        scores = {r["chunk_id"]: (r["vec"][0] + r["vec"][1], r["d"]) for r in got if r["kind"] == E.BOUND}
        st = next((r for r in got if r["kind"] == E.STATS), None)
        elog = np.array(st["vec"][: self.k], dtype=np.float64) if st else np.zeros(self.k)
        return ss, elog, int(st["n"] or 0) if st else 0, int(st["m"] or 0) if st else 0, scores

    def _window(self, rows: pa.Table):
        """The sums over the tasks of a dealt window; the statistics as a (sum W_t, K) array."""
        some = E.of_kind(rows, E.SSTATS)
        ss = np.zeros((int(sum(self.num_terms)), self.k))
        np.add.at(ss, self.rows_at(some), E.vectors_of(some, self.k))
        stats, bound = E.of_kind(rows, E.STATS), E.of_kind(rows, E.BOUND)
        scores = {}
        for c, v, d in zip(bound.column("n").to_pylist(), E.vectors_of(bound, 2), bound.column("m").to_pylist(), strict=True):
            score, docs = scores.get(c, (0.0, 0))
            scores[c] = (score + float(v[0] + v[1]), docs + d)
        return ss, E.vectors_of(stats, self.k).sum(axis=0), sum(stats.column("n").to_pylist()), sum(stats.column("m").to_pylist()), scores

    # ------------------------------------------------------------- scoring
    def transform(self, entries: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """``(doc_id, theta ARRAY)`` with theta = gamma / sum gamma."""
        g = self.gamma(entries, docs)
        return g.select("doc_id", F.expr("transform(gamma, x -> x / aggregate(gamma, 0D, (a, y) -> a + y))").alias("theta"))

    def document_topics(self, entries: DataFrame, minimum_probability: float | None = None, docs: DataFrame | None = None) -> DataFrame:
        """Long form ``(doc_id, topic, p)``, p >= max(min prob, 1e-8)."""
        mp = self.params.minimum_probability if minimum_probability is None else minimum_probability
        mp = max(mp, 1e-8)
        t = self.transform(entries, docs)
        return t.select("doc_id", F.posexplode("theta").alias("topic", "p")).where(F.col("p") >= F.lit(mp))

    def word_phi(self, entries: DataFrame, minimum_phi_value: float | None = None) -> DataFrame:
        """``(doc_id, type_id, term_id, topic, nphi)`` with n*phi >= max(min phi, 1e-8)."""
        mphi = self.params.minimum_phi_value if minimum_phi_value is None else minimum_phi_value
        mphi = max(mphi, 1e-8)
        r = self.estep_rows(entries, "phi", min_phi=mphi).where(F.col("kind") == E.PHI)
        return r.select("doc_id", "type_id", "term_id", F.posexplode("vec").alias("topic", "nphi")).where(F.col("nphi") >= F.lit(mphi))

    def topics_of(self, entries: DataFrame, minimum_probability: float | None = None, minimum_phi_value: float | None = None,
                  per_word_topics: bool | None = None):
        """Document topics; with ``per_word_topics`` also the sorted topics of
        every word and their n*phi values: ``(document_topics, word_topics,
        word_phi)``, all three read from one written pass of the kernel.
        What is not given is the model's own."""
        from ..operators.topics import ranked_topics

        p = self.params
        if not (p.per_word_topics if per_word_topics is None else per_word_topics):
            return self.document_topics(entries, minimum_probability)
        least = max(p.minimum_probability if minimum_probability is None else minimum_probability, 1e-8)
        mphi = max(p.minimum_phi_value if minimum_phi_value is None else minimum_phi_value, 1e-8)
        rows = materialize(self.estep_rows(entries, "phi", min_phi=mphi), "word-topics")
        theta = F.expr("transform(vec, x -> x / aggregate(vec, 0D, (a, y) -> a + y))")
        docs = rows.where(F.col("kind") == E.GAMMA).select("doc_id", F.posexplode(theta).alias("topic", "p")).where(F.col("p") >= least)
        words = rows.where(F.col("kind") == E.PHI)
        phi = words.select("doc_id", "type_id", "term_id", F.posexplode("vec").alias("topic", "nphi")).where(F.col("nphi") >= mphi)
        return docs, ranked_topics(words, mphi), phi

    def __getitem__(self, entries: DataFrame):
        """C3 with the model's own thresholds."""
        return self.topics_of(entries)

    def bound_docs(self, entries: DataFrame) -> DataFrame:
        """A15/A16 document part per document: ``(doc_id, score)``."""
        r = self.estep_rows(entries, "bound").where(F.col("kind") == E.BOUND)
        return r.groupBy("doc_id").agg(F.sum(F.col("vec")[0] + F.col("vec")[1]).alias("score"))
