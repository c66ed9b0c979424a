"""Toxicity scoring with a factorization machine over hashed terms.

Terms of a text: its words and their first four and five bytes (so that
inflected and joined forms share terms), hashed into ``2^BITS`` slots; a slot
counts once a text. The machine scores

    z = b + sum_i w_i + 1/2 (|sum_i v_i|^2 - sum_i |v_i|^2),   score = 1 / (1 + e^-z)

so two terms that mean more together than apart (an insult and a group
mention) get their own weight through v_i . v_j. Linear weights are learnt by
follow-the-regularised-leader with an L1 penalty, the factors by AdaGrad on
the terms whose linear weight is not zero; the thousands of neutral terms of a
long text thus add nothing to its score.

Fitting takes a bounded sample of the labelled rows (the ``sample_rows``
labelled ids with the smallest hashes) of the training folds only, on the
driver, in NumPy. The executors send packed term sets, of about two bytes a
distinct term and at most 264 kB a row however long its text; ids whose sets
do not fit into what is left of ``sample_bytes`` are passed over, those after
them are still taken. The model has a fixed size and goes to the executors as
a broadcast; scoring reads every text whole.

Defined results: null and empty texts score the bias alone; a null id is in
fold 0; an id labelled several times counts with its largest label; null
labels are ignored; without labels of both kinds every score is that of the
initial bias; an empty table gives an empty result; repeated rows give
repeated rows; further columns are ignored (or kept, by ``drop_toxic``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialize
from .text import ALNUM, Slice, mix, slices, words

BITS = 18
RANK = 4
THRESHOLD = 0.7
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 64_000_000
#: examples seen in fitting, in at most EPOCHS passes over the sample
VISITS = 64_000
EPOCHS = 16
PREFIXES = (4, 5)


def term_codes(s: Slice) -> tuple[list[np.ndarray], np.ndarray]:
    """Slot of every word under each kind of term, and the rows' first words."""
    w = words(s, ALNUM)
    with np.errstate(over="ignore"):
        kinds = [w.hash, *(w.prefix_hash(k) for k in PREFIXES)]
        return [(mix(h + np.uint64(7919 * k + 1)) >> np.uint64(64 - BITS)).astype(np.int64) for k, h in enumerate(kinds)], w.rows


def pack(codes: np.ndarray) -> bytes:
    """A sorted set of slots as gaps: a byte 255 for every 255, then the rest."""
    gap = np.diff(codes, prepend=0)
    out = np.full(len(gap) + int((gap // 255).sum()), 255, dtype=np.uint8)
    out[np.cumsum(gap // 255 + 1) - 1] = gap % 255
    return out.tobytes()


class Packed(Sequence):
    """Packed term sets, unpacked one by one when asked for."""

    def __init__(self, column: pa.ChunkedArray):
        self.rows = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for chunk in column.chunks for x in chunk]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> np.ndarray:
        return np.cumsum(self.rows[k], dtype=np.int64)[self.rows[k] < 255]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, s: Slice) -> np.ndarray:
        """Scores of the rows of a slice; only terms with a weight are gathered."""
        codes, rows = term_codes(s)
        n = len(rows) - 1
        pairs = []
        for c in codes:
            at = np.flatnonzero(self.weight[c])
            pairs.append((np.searchsorted(rows, at, "right") - 1 << BITS) | c[at])
        pairs = np.unique(np.concatenate(pairs))
        row, code = pairs >> BITS, pairs & ((1 << BITS) - 1)
        return _sigmoid(_margins(row, self.weight[code], self.factor[code], n, self.bias)[0])


def _margins(row: np.ndarray, w: np.ndarray, v: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    sums = np.stack([np.bincount(row, v[:, k], n) for k in range(v.shape[1])], axis=1)
    z = bias + np.bincount(row, w, n) + 0.5 * ((sums * sums).sum(1) - np.bincount(row, (v * v).sum(1), n))
    return z, sums


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(sets: Sequence[np.ndarray], label: np.ndarray, visits: int = VISITS, batch: int = 32, l1: float = 6.0, l2: float = 1.0, rate: float = 1.0, seed: int = 1) -> Machine:
    """Fit on term sets and 0/1 labels, in a fixed random order."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    weight, lead, seen = (np.zeros(size) for _ in range(3))
    factor, moved = rng.normal(0, 0.05, (size, RANK)), np.ones((size, RANK))
    bias, bias_seen = -2.0, 1.0
    if len(label) == 0 or label.min() == label.max():
        return Machine(bias, weight, factor)
    lengths = np.array([len(x) for x in sets])
    for _ in range(min(EPOCHS, max(1, -(-visits // len(label))))):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            code = np.concatenate([sets[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), lengths[rows])
            active = weight[code] != 0
            v = factor[code] * active[:, None]
            z, sums = _margins(row, weight[code], v, len(rows), bias)
            gap = _sigmoid(z) - label[rows]
            slot, back = np.unique(code, return_inverse=True)
            g = np.bincount(back, gap[row], len(slot))
            sigma = (np.sqrt(seen[slot] + g * g) - np.sqrt(seen[slot])) / rate
            lead[slot] += g - sigma * weight[slot]
            seen[slot] += g * g
            pull = lead[slot]
            weight[slot] = np.where(np.abs(pull) <= l1, 0.0, -(pull - np.sign(pull) * l1) / ((1 + np.sqrt(seen[slot])) / rate + l2))
            on = np.flatnonzero(active)
            if len(on):
                slot, back = np.unique(code[on], return_inverse=True)
                d = gap[row[on]][:, None] * (sums[row[on]] - v[on])
                g = np.stack([np.bincount(back, d[:, k], len(slot)) for k in range(RANK)], axis=1) + 1e-3 * factor[slot]
                moved[slot] += g * g
                factor[slot] -= 0.02 * g / np.sqrt(moved[slot])
            total = gap.sum()
            bias_seen += total * total
            bias -= rate * total / np.sqrt(bias_seen)
    return Machine(bias, weight, factor)


def fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machine:
    """Fit on labelled rows outside fold ``held_out``."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marked = marked.where(fold("doc_id") != held_out).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    rows = rows.select("_h", "doc_id", "text", "y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for s in slices(b.column(2)):
                codes, at = term_codes(s)
                sets += [pack(np.unique(np.concatenate([c[x:y] for c in codes]))) for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary()), b.column(3).cast(pa.int32())], names=["_h", "doc_id", "terms", "y"])

    packed = materialize(rows.mapInArrow(terms, "_h bigint, doc_id bigint, terms binary, y int"), "term-sets")
    skipped, room = [], sample_bytes
    for r in packed.groupBy("_h", "doc_id").agg(F.sum(F.length("terms")).alias("n")).orderBy("_h", "doc_id").collect():  # at most sample_rows rows
        if r.n <= room:
            room -= r.n
        else:
            skipped.append((r.doc_id,))
    if skipped:
        packed = packed.join(F.broadcast(docs.sparkSession.createDataFrame(skipped, "doc_id bigint")), "doc_id", "left_anti")
    # the sample is bounded, so one task holds it; the driver sees the parameters in use only
    sample = packed.repartition(1).sortWithinPartitions("_h", "doc_id", "terms").select("terms", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, pa.schema([("terms", pa.binary()), ("y", pa.int32())]))
        m = fit(Packed(got.column("terms")), (got.column("y").to_numpy() > 0).astype(float))
        code = np.append(-1, np.flatnonzero(m.weight))
        factor = pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32) * RANK, np.concatenate([np.zeros(RANK), m.factor[code[1:]].ravel()]))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.append(m.bias, m.weight[code[1:]])), factor], names=["code", "weight", "factor"])

    found = sample.mapInArrow(learn, "code bigint, weight double, factor array<double>").toArrow()  # at most 2^BITS + 1 rows
    code, weight = found.column("code").to_numpy(), found.column("weight").to_numpy()
    machine = Machine(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, RANK)))
    used = code >= 0
    machine.weight[code[used]] = weight[used]
    machine.factor[code[used]] = found.column("factor").combine_chunks().flatten().to_numpy().reshape(-1, RANK)[used]
    machine.bias = float(weight[~used][0]) if len(code) > used.sum() else fit([], np.zeros(0)).bias
    return machine


def scored(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out`` (replaced if there)."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            parts = [model.scores(s) for s in slices(b.column(at))]
            yield b.append_column(out, pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    return docs.mapInArrow(add, StructType([*docs.schema, StructField(out, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    machine = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    out = "_toxicity"
    while out in docs.columns:
        out += "_"
    return scored(docs, train(docs, labels), out=out).where(F.col(out) < threshold).drop(out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
