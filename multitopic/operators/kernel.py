"""NumPy E-step kernel, vectorised across the documents of one Arrow batch.

Variational E step for a batch of documents (T types, K topics):

    phinorm_w = expElogtheta_d . eb_w + eps
    gamma_d   = alpha + expElogtheta_d * (1/T) * sum_w cnt_w / phinorm_w * eb_w
    expElogtheta_d = exp(psi(gamma_d) - psi(sum gamma_d))

repeated until the mean absolute change of gamma_d drops below the
threshold or ``iterations`` rounds are done. The (type, term) partial
sufficient statistics are ``expElogtheta_d * cnt_w / phinorm_w * eb_w``.

Entries of a batch are flattened in document order (CSR layout:
``lengths`` per document); sums per document use ``np.add.reduceat``.
Converged documents are dropped from the working set every round.
"""

from __future__ import annotations

import numpy as np

from ..functions.special import dirichlet_expectation_np


def seg_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum rows of ``values`` per contiguous segment; empty segments -> 0."""
    out = np.zeros((len(lengths),) + values.shape[1:], dtype=np.float64)
    nz = lengths > 0
    if values.shape[0] == 0 or not nz.any():
        return out
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[nz]
    out[nz] = np.add.reduceat(values, starts, axis=0)
    return out


def infer(
    lengths: np.ndarray,
    cnt: np.ndarray,
    eb: np.ndarray,
    alpha: np.ndarray,
    num_types: int,
    iterations: int,
    threshold: float,
    eps: float,
    gamma0: np.ndarray | None = None,
):
    """Run the E step for documents with ``lengths`` entries each.

    Returns gamma (D,K), expElogtheta (D,K), iters (D,), converged (D,), and
    ``w`` = cnt / phinorm per entry for the final gamma."""
    lengths = np.asarray(lengths, dtype=np.int64)
    d_count = len(lengths)
    k = len(alpha)
    gamma = np.ones((d_count, k)) if gamma0 is None else np.array(gamma0, dtype=np.float64)
    et = np.exp(dirichlet_expectation_np(gamma))
    iters = np.zeros(d_count, dtype=np.int32)
    conv = np.zeros(d_count, dtype=bool)
    doc_of = np.repeat(np.arange(d_count), lengths)

    act = np.arange(d_count)
    a_len, a_cnt, a_eb, a_doc = lengths, cnt, eb, np.repeat(np.arange(d_count), lengths)
    inv_t = 1.0 / num_types
    for _ in range(iterations):
        if len(act) == 0:
            break
        et_a = et[act]
        phinorm = np.einsum("nk,nk->n", et_a[a_doc], a_eb) + eps
        s = seg_sum((a_cnt / phinorm)[:, None] * a_eb, a_len)
        g_new = alpha + et_a * s * inv_t
        e_new = np.exp(dirichlet_expectation_np(g_new))
        change = np.mean(np.abs(g_new - gamma[act]), axis=1)
        gamma[act] = g_new
        et[act] = e_new
        iters[act] += 1
        done = change < threshold
        if done.any():
            conv[act[done]] = True
            keep = ~done
            keep_e = np.repeat(keep, a_len)
            act = act[keep]
            a_len = a_len[keep]
            a_cnt = a_cnt[keep_e]
            a_eb = a_eb[keep_e]
            a_doc = np.repeat(np.arange(len(act)), a_len)
    w = cnt / (np.einsum("nk,nk->n", et[doc_of], eb) + eps) if len(cnt) else np.zeros(0)
    return gamma, et, iters, conv, w


def reduce_rows(keys: np.ndarray, vals: np.ndarray):
    """Sum rows of ``vals`` that share a key (sort-based)."""
    if len(keys) == 0:
        return keys, vals
    order = np.argsort(keys, kind="stable")
    ks = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
    return ks[starts], np.add.reduceat(vals[order], starts, axis=0)


class SparseAccumulator:
    """Partial sufficient statistics of one task, keyed by a 64-bit
    (type, term) key; compacted whenever it grows past ``max_bytes`` of
    vectors and handed out at four times that, whatever K is."""

    def __init__(self, k: int, max_bytes: int = 32 << 20):
        self.k = k
        self.max_rows = max(1000, max_bytes // (8 * k))
        self.keys: list[np.ndarray] = []
        self.vals: list[np.ndarray] = []
        self.rows = 0

    def add(self, keys: np.ndarray, vals: np.ndarray):
        keys, vals = reduce_rows(keys, vals)
        self.keys.append(keys)
        self.vals.append(vals)
        self.rows += len(keys)
        if self.rows > self.max_rows and len(self.keys) > 1:
            self.compact()

    def compact(self):
        if not self.keys:
            return
        k, v = reduce_rows(np.concatenate(self.keys), np.concatenate(self.vals))
        self.keys, self.vals, self.rows = [k], [v], len(k)

    def full(self) -> bool:
        return self.rows > 4 * self.max_rows

    def drain(self):
        self.compact()
        if not self.keys:
            return np.zeros(0, dtype=np.int64), np.zeros((0, self.k))
        k, v = self.keys[0], self.vals[0]
        self.keys, self.vals, self.rows = [], [], 0
        return k, v
