"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the two tokens on
either side of it:

    hidden = tanh(b + sum_p E_p[token at offset p]),  p in -2, -1, 1, 2
    P(token) = softmax(A hidden)[c1] * softmax(B (hidden + C[c1]))[c2]

with the leaf (c1, c2) of the token in a tree of 64 x 64 leaves. The
``FREQUENT`` words that are most frequent in the corpus (exact counts over all
documents) have leaves of their own, by rank; other words share the remaining
leaves by hash. Places beyond the text have a token of their own. A document's
score is the sum of the conditional log probabilities of all its tokens.

Every text is tokenised once into written leaf numbers, dealt by a hash of id
and text into learner blocks of about ``BLOCK`` tokens. Their number depends on
the corpus alone, so the network does not depend on how it is partitioned and
more tasks do not learn less each. Rows that are equal in id and text and hold
more than a block are dealt round.

Training sees every document: in each round the learner of every block starts
from the broadcast network, masks every ``MASK_EVERY``-th token of each of its
texts (the next ones each round, so that in ``MASK_EVERY`` rounds every token is
predicted once) and runs AdaGrad steps in NumPy; the parameter rows it touched
count by how often it touched them. A task adds up its blocks, Spark adds up the
tasks (the driver receives one network of fixed size). What is gathered thus
grows with the corpus, and a lost task is simply run again from the same network.

Defined results: null, empty and wordless texts have 0 tokens, score 0 and
no mean; repeated rows give repeated rows; a null id is kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, materialize, source_path
from .text import ALNUM, as_long, slices, words

SIDE = 64
VOCAB = SIDE * SIDE
FREQUENT = 3072
DIM = 16
OFFSETS = (-2, -1, 1, 2)
PAD = 2
MASK_EVERY = 2
BATCH = 2048
RATE = 0.1
#: tokens of a learner block; words per block of the word counts
BLOCK = 1 << 20
COUNT_BLOCK = 1 << 22

#: parameter rows: embeddings per offset (the last of each is the place beyond
#: the text), hidden bias, A with bias, B with bias, C
_EMB = len(OFFSETS) * (VOCAB + 1)
_HID, _A, _B, _C = _EMB, _EMB + 1, _EMB + 1 + SIDE, _EMB + 1 + 2 * SIDE
ROWS = _C + SIDE
WIDTH = DIM + 1


def initial(seed: int = 3) -> np.ndarray:
    net = np.zeros((ROWS, WIDTH), dtype=np.float32)
    net[:, :DIM] = np.random.default_rng(seed).normal(0, 0.1, (ROWS, DIM))
    net[_HID] = 0
    return net


class Leaves:
    """Leaf of every word: the rank of a frequent one, else a shared leaf."""

    def __init__(self, ranked: np.ndarray):
        order = np.argsort(ranked)
        self.hashes, self.rank = ranked[order], order.astype(np.uint16)

    def of(self, h: np.ndarray) -> np.ndarray:
        out = (FREQUENT + h % np.uint64(VOCAB - FREQUENT)).astype(np.uint16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            out[known] = self.rank[at[known]]
        return out


def frequent_words(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> Leaves:
    """The most frequent words by exact counts, equal counts by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for s in slices(b.column(0)):
                held.append(words(s, ALNUM).hash)
                if sum(map(len, held)) >= COUNT_BLOCK:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(n)], names=["word", "n"])

    sums = docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("n").desc(), "word").limit(most).select("word").toArrow()  # at most FREQUENT rows
    return Leaves(top.column("word").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64))


def token_blocks(docs: DataFrame, leaves: Leaves, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(block, ids, sizes, tokens)``: one row per learner block, written;
    ``tokens`` holds the leaves of its documents as 16-bit numbers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(leaves)
    thin = docs.select(id_col, text, F.xxhash64(id_col, text).alias("_key"))
    id_type = thin.schema[id_col].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows: list[bytes] = []
            for s in slices(b.column(1)):
                w = words(s, ALNUM)
                leaf = known.of(w.hash)
                rows += [leaf[x:y].tobytes() for x, y in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)]
            n = pa.array([len(r) // 2 for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n, pa.array(rows, pa.binary())], names=["id", "key", "n", "leaf"])

    rows = materialize(thin.mapInArrow(tokenise, f"id {id_type}, key bigint, n bigint, leaf binary"), "tokens")
    shared.destroy()
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block))
    # at most as many keys as there are blocks hold more than a block
    crowded = rows.groupBy("key").agg(F.sum("n").alias("held")).where(F.col("held") > block).select("key", F.lit(True).alias("crowded"))
    turn = F.when(F.col("crowded"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    dealt = rows.join(F.broadcast(crowded), "key", "left").select(F.pmod(F.xxhash64("key", turn), F.lit(blocks)).alias("block"), "key", "id", "leaf")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "key")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            at = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if x == y:
                    continue
                if held and at[x] != now:
                    yield row(now, held)
                    held = []
                now = at[x]
                held.append(b.slice(x, y - x))
        if held:
            yield row(now, held)

    def row(now: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = pa.Table.from_batches(held)
        leaf = one.column("leaf").to_pylist()
        ids = one.column("id").combine_chunks()
        ends = pa.array([0, len(ids)], pa.int32())
        sizes = pa.array([len(x) // 2 for x in leaf], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, sizes), pa.array([b"".join(leaf)], pa.binary())],
            names=["block", "ids", "sizes", "tokens"],
        )

    out = materialize(dealt.mapInArrow(gather, f"block bigint, ids array<{id_type}>, sizes array<int>, tokens binary"), "token-blocks")
    drop_path(spark, source_path(rows))
    return out


class Texts:
    """The texts of a block with places beyond each text between them."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(sizes) - sizes
        self.place = np.arange(len(tokens)) - np.repeat(first, sizes)
        self.at = np.arange(len(tokens)) + PAD * (np.repeat(np.arange(len(sizes)), sizes) + 1)
        self.padded = np.full(len(tokens) + PAD * (len(sizes) + 1), VOCAB, dtype=np.int64)
        self.padded[self.at] = tokens

    def pairs(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at the picked places, and the parameter rows of their contexts."""
        at = self.at[pick]
        ctx = np.stack([self.padded[at + off] + k * (VOCAB + 1) for k, off in enumerate(OFFSETS)], axis=1)
        return self.padded[at], ctx


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, Texts]]:
    """Ids, sizes and texts of each block row (columns ids, sizes, tokens)."""
    for i in range(batch.num_rows):
        sizes = batch.column("sizes")[i].values.to_numpy()
        yield batch.column("ids")[i].values, sizes, Texts(np.frombuffer(batch.column("tokens")[i].as_py(), dtype=np.uint16), sizes)


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(exp(z - max), their sum)``; z is overwritten."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], dtype=z.dtype)


class Network:
    """The parameters laid out for products, rebuilt after they change."""

    def __init__(self, net: np.ndarray):
        self.emb = np.ascontiguousarray(net[:_EMB, :DIM])
        self.hid, self.c = net[_HID, :DIM], np.ascontiguousarray(net[_C:, :DIM])
        self.a, self.b = np.ascontiguousarray(net[_A:_B]), np.ascontiguousarray(net[_B:_C])

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        """tanh of the summed embeddings, and a column of ones for the biases."""
        h = np.ones((len(ctx), WIDTH), dtype=np.float32)
        z = np.take(self.emb, ctx[:, 0], axis=0)
        for k in range(1, ctx.shape[1]):
            z += np.take(self.emb, ctx[:, k], axis=0)
        z += self.hid
        np.tanh(z, out=h[:, :DIM])
        return h

    def below(self, h: np.ndarray, c1: np.ndarray) -> np.ndarray:
        h = h.copy()
        h[:, :DIM] += np.take(self.c, c1, axis=0)
        return h


def log_probs(net: np.ndarray, token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    m = Network(net)
    return _log_probs(m, token, ctx)


def _log_probs(m: Network, token: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    h = m.hidden(ctx)
    rows, c1, c2 = np.arange(len(token)), token // SIDE, token % SIDE
    e, total = _softmax(h @ m.a.T)
    e2, total2 = _softmax(m.below(h, c1) @ m.b.T)
    tiny = np.float32(1e-30)
    return np.log(np.maximum(e[rows, c1], tiny) / total).astype(float) + np.log(np.maximum(e2[rows, c2], tiny) / total2)


class Learner:
    """AdaGrad on a block's copy of the network; counts touched rows."""

    def __init__(self, net: np.ndarray):
        self.net = Network(net.copy())
        m = self.net
        self.parts = {"emb": m.emb, "hid": m.hid[None, :], "a": m.a, "b": m.b, "c": m.c}
        self.square = {k: np.full(v.shape, 1e-4, dtype=np.float32) for k, v in self.parts.items()}
        self.touched = {k: np.zeros(len(v)) for k, v in self.parts.items()}

    def gradients(self, token: np.ndarray, ctx: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Summed gradients of the negative log likelihood by a, b, hid, and
        those by each token's hidden state (before tanh) and C row."""
        m = self.net
        c1, c2, rows = token // SIDE, token % SIDE, np.arange(len(token))
        h = m.hidden(ctx)
        g1, total = _softmax(h @ m.a.T)
        g1 *= (1 / total)[:, None]
        g1[rows, c1] -= 1
        h2 = m.below(h, c1)
        g2, total = _softmax(h2 @ m.b.T)
        g2 *= (1 / total)[:, None]
        g2[rows, c2] -= 1
        d2 = g2 @ m.b[:, :DIM]
        dh = g1 @ m.a[:, :DIM]
        dh += d2
        dh *= 1 - h[:, :DIM] ** 2
        return {"a": g1.T @ h, "b": g2.T @ h2, "hid": dh.sum(0, keepdims=True)}, dh, d2

    def step(self, token: np.ndarray, ctx: np.ndarray) -> None:
        dense, dh, d2 = self.gradients(token, ctx)
        for k, g in dense.items():
            self._move(k, slice(None), g / len(token), len(token))
        self._scatter("c", token // SIDE, d2)
        # the embeddings of one offset after another: rows of different offsets differ
        for k in range(ctx.shape[1]):
            self._scatter("emb", ctx[:, k], dh)

    def _scatter(self, part: str, row: np.ndarray, grad: np.ndarray) -> None:
        """Moves each row by the mean of its gradients."""
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(first, append=len(row))
        sums = np.add.reduceat(np.take(grad, order, axis=0), first, axis=0)
        sums *= (1 / count).astype(np.float32)[:, None]
        self._move(part, row[first], sums, count)

    def _move(self, part: str, row, grad: np.ndarray, count) -> None:
        square = self.square[part][row] + grad * grad
        self.square[part][row] = square
        self.parts[part][row] -= RATE * grad / np.sqrt(square)
        self.touched[part][row] += count

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """``(parameters, touched)`` in the rows of the network."""
        wide = [v if v.shape[1] == WIDTH else np.pad(v, ((0, 0), (0, 1))) for v in self.parts.values()]
        return np.concatenate(wide), np.concatenate(list(self.touched.values()))


def train_round(blocks: DataFrame, net: np.ndarray, round_: int, every: int = MASK_EVERY) -> np.ndarray:
    """One pass over all blocks; returns the network averaged over them."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((ROWS, WIDTH)), np.zeros(ROWS)
        for b in batches:
            for _, _, texts in _texts(b):
                learner = Learner(shared.value)
                pick = np.flatnonzero(texts.place % every == round_ % every)
                for at in range(0, len(pick), BATCH):
                    learner.step(*texts.pairs(pick[at : at + BATCH]))
                values, touched = learner.result()
                total += values * touched[:, None]
                weight += touched
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at]), *(pa.array(total[at, k]) for k in range(WIDTH))], names=names)

    names = ["row", "weight", *(f"v{k}" for k in range(WIDTH))]
    parts = blocks.select("ids", "sizes", "tokens").mapInArrow(learn, "row int, weight double, " + ", ".join(f"v{k} double" for k in range(WIDTH)))
    sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()  # at most ROWS rows
    out = net.copy()
    if sums.num_rows:
        at = sums.column("row").to_numpy()
        values = np.stack([sums.column(f"v{k}").to_numpy() for k in range(WIDTH)], axis=1)
        # sums arrive in any order; rounding makes reruns agree
        out[at] = np.round(values / sums.column("weight").to_numpy()[:, None], 6).astype(np.float32)
    shared.destroy()
    return out


def fit(blocks: DataFrame, rounds: int | None = None, every: int = MASK_EVERY) -> np.ndarray:
    """The network after ``rounds`` passes (``every`` of them unless given)."""
    net = initial()
    for k in range(every if rounds is None else rounds):
        net = train_round(blocks, net, k, every)
    return net


def score_blocks(blocks: DataFrame, net: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, pll, mean_pll)`` per document."""
    shared = blocks.sparkSession.sparkContext.broadcast(net)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Network(shared.value)
        for b in batches:
            for ids, sizes, texts in _texts(b):
                every = np.arange(len(texts.at))
                parts = [_log_probs(m, *texts.pairs(every[at : at + 4096])) for at in range(0, len(every), 4096)]
                total = np.concatenate([[0.0], np.cumsum(np.concatenate(parts) if parts else np.zeros(0))])
                ends = np.cumsum(sizes)
                pll = total[ends] - total[ends - sizes]
                mean = pa.array(pll / np.maximum(sizes, 1), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(pll), mean], names=[id_col, "n_tokens", "pll", "mean_pll"])

    return blocks.select("ids", "sizes", "tokens").mapInArrow(score, f"`{id_col}` {id_type}, n_tokens bigint, pll double, mean_pll double")


def pseudo_likelihood(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``(id, n_tokens, pll, mean_pll)`` of every row of ``docs`` under the
    network of all of them."""
    blocks = token_blocks(docs, frequent_words(docs, text), text, id_col, block)
    return score_blocks(blocks, fit(blocks), id_col)


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
