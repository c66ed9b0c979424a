"""Distributed E step.

Documents travel as one row each: ``(doc_id, bag ARRAY<STRUCT<type_id,
term_id, cnt>>)`` (built once per corpus and reused by every E step).
Each task runs the NumPy kernel over Arrow batches of documents and emits
one tagged union of rows, so the kernel runs once per document:

    kind 0  gamma row        doc_id, vec = gamma, iters, converged
    kind 1  sstats partial   type_id, term_id, vec (summed inside the task)
    kind 2  task statistics  vec = sum of E[log theta], n = docs, m = converged
    kind 3  word-phi row     doc_id, type_id, term_id, vec = n * phi
    kind 4  bound row        doc_id, vec = [likelihood part, theta part], n = chunk

Two strategies for exp E[log beta] (``eb``), same results:

* ``broadcast``: ``eb`` as a (sum W_t, K) array in a broadcast variable --
  only when K * sum W_t * 8 bytes is below the model's limit (the size is
  known exactly from the vocabulary, so the bound is proven);
* ``join``: nothing of vocabulary size reaches the driver, and no K-vector
  travels per entry. Documents stay nested with their ids and are dealt into
  buckets; each bucket is co-grouped with the ``eb`` rows of the distinct terms
  its documents hold (:func:`cogroup`), so a vector is shuffled once per bucket
  and term, however many entries of the bucket name the term.

Documents with more than ``max_doc_terms`` entries ("hot" documents, e.g. one
customer holding a third of all rows) never go through a single task: they
are iterated as distributed aggregations, see :func:`hot_estep`.

Training a small state over many windows deals the nested documents into blocks
per window once (:func:`deal`): an update is then one job over the few partitions
that hold its window, whatever the size of the corpus (:func:`window_rows`).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import dirichlet_expectation_np, lgamma_np
from .kernel import SparseAccumulator, infer, reduce_rows, seg_sum
from .vectors import sum_vectors

OUT_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("type_id", T.IntegerType()),
        T.StructField("term_id", T.IntegerType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
        T.StructField("iters", T.IntegerType()),
        T.StructField("converged", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("m", T.LongType()),
    ]
)
_ARROW_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()),
        ("doc_id", pa.int64()),
        ("type_id", pa.int32()),
        ("term_id", pa.int32()),
        ("vec", pa.list_(pa.float64())),
        ("iters", pa.int32()),
        ("converged", pa.bool_()),
        ("n", pa.int64()),
        ("m", pa.int64()),
    ]
)

GAMMA, SSTATS, STATS, PHI, BOUND = 0, 1, 2, 3, 4


def _vec_array(mat: np.ndarray) -> pa.Array:
    mat = np.ascontiguousarray(mat, dtype=np.float64)
    n, k = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32) if n else np.zeros(1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.ravel()))


def _batch(kind, n_rows, doc_id=None, type_id=None, term_id=None, vec=None, iters=None, conv=None, n=None, m=None):
    def col(v, typ):
        if v is None:
            return pa.nulls(n_rows, typ)
        return pa.array(v, typ)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n_rows, kind, dtype=np.int32)),
            col(doc_id, pa.int64()),
            col(type_id, pa.int32()),
            col(term_id, pa.int32()),
            _vec_array(vec) if vec is not None else pa.nulls(n_rows, pa.list_(pa.float64())),
            col(iters, pa.int32()),
            col(conv, pa.bool_()),
            col(n, pa.int64()),
            col(m, pa.int64()),
        ],
        schema=_ARROW_SCHEMA,
    )


def _sub_ranges(lengths: np.ndarray, max_entries: int):
    """Split documents into consecutive groups of at most ``max_entries``
    entries (a group always holds at least one document)."""
    start, acc = 0, 0
    for i, ln in enumerate(lengths):
        if acc and acc + ln > max_entries:
            yield start, i
            start, acc = i, 0
        acc += int(ln)
    if start < len(lengths):
        yield start, len(lengths)


def make_kernel(
    mode: str,
    alpha: np.ndarray,
    num_types: int,
    iterations: int,
    threshold: float,
    eps: float,
    eb_bc=None,
    type_offsets: np.ndarray | None = None,
    min_phi: float = 0.0,
    el_bc=None,
):
    """Build the function over batches of nested documents. ``mode`` in {gamma,
    train, phi, bound}. The topic vectors come as broadcasts (``eb_bc``,
    ``mapInArrow``); without them the function takes ``(batches, find, eb,
    el)`` with ``find(type_ids, term_ids)`` giving rows of ``eb`` (a bucket of
    :func:`cogroup`). Bound mode also needs E[log beta] of lambda (``el``):
    inference may run on other weights, and log(exp . exp) would underflow. Train
    mode with ``el`` gives the bound rows of the same pass too. A column
    ``gamma0`` starts the documents' weights, else they start at ones."""
    alpha = np.asarray(alpha, dtype=np.float64)
    k = len(alpha)
    max_entries = max(1, (32 << 20) // (8 * k))  # ~32 MB per working array

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        eb = eb_bc.value
        el = el_bc.value if el_bc is not None else None
        yield from work(batches, lambda t, w: type_offsets[t] + w, eb, el)

    def work(batches, find, eb_all, el_all) -> Iterator[pa.RecordBatch]:
        acc = SparseAccumulator(k) if mode == "train" else None
        elog_sum = np.zeros(k)
        n_docs = 0
        n_conv = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            doc_ids = b.column(b.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            bag = b.column(b.schema.get_field_index("bag"))
            lengths = bag.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = bag.flatten()
            t_all = flat.field("type_id").to_numpy(zero_copy_only=False).astype(np.int64)
            w_all = flat.field("term_id").to_numpy(zero_copy_only=False).astype(np.int64)
            c_all = flat.field("cnt").to_numpy(zero_copy_only=False).astype(np.float64)
            at = b.schema.get_field_index("gamma0")
            gamma0 = _mat(b.column(at), k) if at >= 0 else None
            at = b.schema.get_field_index("chunk_id")
            chunk = b.column(at).to_numpy(zero_copy_only=False) if at >= 0 else None
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for lo, hi in _sub_ranges(lengths, max_entries):
                elo, ehi = int(starts[lo]), int(ends[hi - 1]) if hi > lo else int(starts[lo])
                ln = lengths[lo:hi]
                t, w, c = t_all[elo:ehi], w_all[elo:ehi], c_all[elo:ehi]
                row = find(t, w)
                eb = eb_all[row] if len(t) else np.zeros((0, k))
                start = gamma0[lo:hi] if gamma0 is not None else None
                gamma, et, iters, conv, wgt = infer(ln, c, eb, alpha, num_types, iterations, threshold, eps, start)
                ids = doc_ids[lo:hi]
                if mode == "bound" or (mode == "train" and el_all is not None):
                    el = el_all[row] if len(t) else np.zeros((0, k))
                    lse = log_mixture(dirichlet_expectation_np(gamma)[np.repeat(np.arange(len(ln)), ln)], el)
                    ll = seg_sum((c * lse)[:, None], ln)[:, 0]
                    part = np.stack([ll, theta_part(gamma, alpha)], axis=1)
                    yield _batch(BOUND, len(ids), doc_id=ids, vec=part, n=chunk[lo:hi] if chunk is not None else None)
                if mode == "gamma":
                    yield _batch(GAMMA, len(ids), doc_id=ids, vec=gamma, iters=iters, conv=conv)
                elif mode == "train":
                    part = et[np.repeat(np.arange(len(ln)), ln)] * wgt[:, None] * eb
                    acc.add((t << 32) | w, part)
                    elog_sum += dirichlet_expectation_np(gamma).sum(axis=0)
                    n_docs += len(ids)
                    n_conv += int(conv.sum())
                    if acc.full():
                        keys, vals = acc.drain()
                        yield _batch(SSTATS, len(keys), type_id=keys >> 32, term_id=keys & 0xFFFFFFFF, vec=vals)
                elif mode == "phi":
                    yield _batch(GAMMA, len(ids), doc_id=ids, vec=gamma, iters=iters, conv=conv)
                    nphi = et[np.repeat(np.arange(len(ln)), ln)] * wgt[:, None] * eb
                    keep = (nphi >= min_phi).any(axis=1) if min_phi > 0 else np.ones(len(t), dtype=bool)
                    yield _batch(
                        PHI, int(keep.sum()), doc_id=np.repeat(ids, ln)[keep], type_id=t[keep], term_id=w[keep], vec=nphi[keep]
                    )
        if mode == "train":
            keys, vals = acc.drain()
            if len(keys):
                yield _batch(SSTATS, len(keys), type_id=keys >> 32, term_id=keys & 0xFFFFFFFF, vec=vals)
            yield _batch(STATS, 1, vec=elog_sum[None, :], n=[n_docs], m=[n_conv])

    return fn if eb_bc is not None else work


def log_mixture(elogtheta: np.ndarray, elogbeta: np.ndarray) -> np.ndarray:
    """log sum_k exp(E[log theta_k] + E[log beta_k]) per row (A15, F-5),
    shifted by the row's maximum so that nothing underflows."""
    if not len(elogbeta):
        return np.zeros(0)
    both = elogtheta + elogbeta
    top = both.max(axis=1)
    return top + np.log(np.exp(both - top[:, None]).sum(axis=1))


def theta_part(gamma: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """E[log p(theta | alpha) - log q(theta | gamma)] per document."""
    elog = dirichlet_expectation_np(gamma)
    return (
        ((alpha - gamma) * elog).sum(axis=1)
        + (lgamma_np(gamma) - lgamma_np(alpha)).sum(axis=1)
        + lgamma_np(alpha.sum())
        - lgamma_np(gamma.sum(axis=1))
    )


#: entries per partition of nested documents
NEST_ENTRIES = 400_000


def nest(entries: DataFrame, docs: DataFrame | None = None, keys=("doc_id",), sort_chunks: bool = False, size: int = 0) -> DataFrame:
    """Entries -> one row per document with its bag. When ``docs`` is
    given, exactly its documents are returned, those without entries with
    an empty bag. ``keys`` may carry per-document columns such as
    ``chunk_id`` along.

    One shuffle: the listed documents enter as marker rows of the same
    aggregation (no join). The explicit partition count on ``doc_id`` is
    left alone by AQE, so the CPU-heavy kernel gets equal tasks instead of
    a few coalesced ones; it grows with the number of entries (``size``, if
    known), so that a task's sort and its Arrow batches do not. ``sort_chunks`` (a table written once and filtered
    by chunk range many times) sorts every partition by ``(chunk_id,
    doc_id)``: a window's ``chunk_id`` filter, pushed to the Parquet scan,
    skips the row groups of other windows, while every window still spans
    all partitions and so keeps the kernel's full parallelism. (A range
    layout on chunk_id would skip whole files, but leaves a window with
    only a few tasks; measured 2x slower per window.)"""
    keys = list(keys)
    rows = entries.select(*keys, F.struct("type_id", "term_id", "cnt").alias("_i"), F.lit(False).alias("_d"))
    if docs is not None:
        none = F.lit(None).cast(rows.schema["_i"].dataType)
        rows = rows.unionByName(docs.select(*keys, none.alias("_i"), F.lit(True).alias("_d")))
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // NEST_ENTRIES))
    bag = rows.repartition(n, "doc_id").groupBy(*keys).agg(F.collect_list("_i").alias("bag"), F.max("_d").alias("_d"))
    if docs is not None:
        bag = bag.where(F.col("_d"))
    bag = bag.drop("_d")
    order = [c for c in keys if c == "chunk_id"] + ["doc_id"]
    return bag.sortWithinPartitions(*order) if sort_chunks else bag


def _columns(docs: DataFrame) -> list[str]:
    """What the kernel reads, so the scan below keeps its column pruning."""
    return ["doc_id", "bag"] + [c for c in docs.columns if c in ("gamma0", "chunk_id")]


def run(docs: DataFrame, fn) -> DataFrame:
    """Apply the kernel with broadcast topic vectors."""
    return docs.select(*_columns(docs)).mapInArrow(fn, OUT_SCHEMA)


# ------------------------------------------------------------ dealt windows
#: entries of a window that a task works off at least and at most
SLICE_LEAST, SLICE_MOST = 10_000, 400_000
#: entries per block, and per partition of blocks unless one slice of a window has more
BLOCK_ENTRIES, RUN_ENTRIES = 32_000, 64_000
#: partitions of blocks at most, unless the slices of a window are more
RUN_PARTITIONS = 4_096


@dataclass
class Given:
    """A value that travels with the function, read like a broadcast variable."""

    value: object


@dataclass
class Dealt:
    """Documents as blocks per chunk. Windows of ``every`` chunks are cut into
    ``slices``; ``run`` neighbouring windows share the partitions of their slices."""

    blocks: object  # RDD of rows (part, chunk_id, block)
    every: int
    run: int
    slices: int

    def partitions(self, lo: int) -> list[int]:
        """Those that hold the window starting at chunk ``lo``."""
        first = lo // self.every // self.run * self.slices
        return list(range(first, first + self.slices))


def slice_count(entries: int, slots: int) -> int:
    """Tasks for a window of ``entries``: as many as there are slots where each has
    enough to do, and more of them where they would hold too much."""
    return max(1, min(slots, entries // SLICE_LEAST), -(-entries // SLICE_MOST))


def deal(nested: DataFrame, every: int, windows: int, most: int, slices: int) -> Dealt | None:
    """Deal ``nested`` documents (with ``chunk_id``) into ``windows`` windows of
    ``every`` chunks and at most ``most`` entries. The blocks stay on the executors'
    disks; lost ones are made again from ``nested``."""
    run = max(1, RUN_ENTRIES * slices // max(1, most), -(-windows * slices // RUN_PARTITIONS))
    n = -(-windows // run) * slices
    docs = nested.select(*_columns(nested))
    blocks = docs.mapInArrow(_packed(every * run, slices), "part int, chunk_id bigint, block binary").repartitionById(n, F.col("part")).rdd
    if blocks.getNumPartitions() != n:  # a plan that does not keep the partition ids
        return None
    return Dealt(blocks.persist(StorageLevel.DISK_ONLY), every, run, slices)


def _packed(chunks: int, slices: int):
    """Neighbouring documents of a chunk as Arrow streams, dealt in turn to the
    slices of the ``chunks`` that share their partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            if b.num_rows == 0:
                continue
            chunk = b.column(b.schema.get_field_index("chunk_id")).to_numpy(zero_copy_only=False)
            lengths = b.column(b.schema.get_field_index("bag")).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            parts, ids, blobs = [], [], []
            for i, j in zip(at, np.append(at[1:], len(chunk)), strict=True):
                c = int(chunk[i])
                for lo, hi in _sub_ranges(lengths[i:j], BLOCK_ENTRIES):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as out:
                        out.write_batch(b.slice(i + lo, hi - lo))
                    parts.append(c // chunks * slices + (me + seen[c]) % slices)
                    seen[c] += 1
                    ids.append(c)
                    blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "chunk_id", "block"])

    return pack


def window_rows(dealt: Dealt, lo: int, hi: int, fn) -> pa.Table:
    """Kernel-union rows of a training window ``[lo, hi)``, one job over its own
    partitions. A task gives its statistics and, where it scores, a bound row per
    chunk (``m`` documents) instead of one per document."""

    def work(rows):
        found = [pa.ipc.open_stream(r.block).read_all() for r in rows if lo <= r.chunk_id < hi]
        if found:
            out = pa.Table.from_batches(_per_chunk(fn(iter(pa.concat_tables(found).combine_chunks().to_batches()))), _ARROW_SCHEMA)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ARROW_SCHEMA) as stream:
                stream.write_table(out)
            yield sink.getvalue().to_pybytes()

    got = dealt.blocks.context.runJob(dealt.blocks, work, dealt.partitions(lo))
    return pa.concat_tables([_ARROW_SCHEMA.empty_table(), *(pa.ipc.open_stream(x).read_all() for x in got)])


def _per_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows and b.column(0)[0].as_py() == BOUND:
            keys, vals = reduce_rows(b.column(7).to_numpy(), np.column_stack([_mat(b.column(4), 2), np.ones(b.num_rows)]))
            b = _batch(BOUND, len(keys), vec=vals[:, :2], n=keys, m=vals[:, 2].astype(np.int64))
        yield b


def of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pc.equal(rows.column("kind"), kind)).combine_chunks()


def vectors_of(rows: pa.Table, k: int) -> np.ndarray:
    """The vectors of kernel-union rows as a matrix."""
    return _mat(rows.column("vec").combine_chunks(), k) if rows.num_rows else np.zeros((0, k))


#: bytes of topic vectors a bucket may hold at most, entries it should hold at least
BUCKET_BYTES = 64 << 20
BUCKET_ENTRIES = 20_000


def bucket_count(entries: int, chunks: int, k: int, partitions: int) -> int:
    """Buckets per chunk: as large as their vectors allow (terms repeat within a
    bucket), but several per task slot while they hold enough entries."""
    per = -(-entries // max(1, chunks))
    return max(1, -(-per // max(1, BUCKET_BYTES // (8 * k))), min(4 * partitions, per // BUCKET_ENTRIES))


def cogroup(docs: DataFrame, topics: DataFrame, per_chunk: int, work) -> DataFrame:
    """Apply the kernel to nested ``docs`` (with ``chunk_id``) and the
    ``topics`` rows ``(type_id, term_id, eb[, el])`` of their terms.

    The distinct (bucket, term) pairs meet the topic table in a join of ids; a
    term is there at most once a bucket, so no term is hot. Both sides then go
    to their bucket: the documents with ids and counts only."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.col("chunk_id") * F.lit(per_chunk) + F.pmod(F.xxhash64("doc_id"), F.lit(per_chunk))
    docs = docs.select(bucket.cast("bigint").alias("bucket"), *_columns(docs))
    named = docs.select("bucket", F.explode("bag").alias("e")).select("bucket", "e.type_id", "e.term_id").distinct()
    vectors = [c for c in ("eb", "el") if c in topics.columns]
    needed = named.join(topics.select("type_id", "term_id", *vectors), ["type_id", "term_id"])
    needed = needed.select(F.col("bucket").alias("into"), "type_id", "term_id", *vectors)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        t, w = (right.column(c).to_numpy().astype(np.int64) for c in ("type_id", "term_id"))
        key = (t << 32) | w
        order = np.argsort(key)
        key = key[order]
        eb, el = (_mat(right.column(c).combine_chunks(), -1)[order] if c in right.column_names and len(key) else None for c in ("eb", "el"))
        rows = work(left.combine_chunks().to_batches(), lambda a, b: np.searchsorted(key, (a << 32) | b), eb, el)
        return pa.Table.from_batches(list(rows), _ARROW_SCHEMA)

    # explicit counts: AQE would merge the buckets' partitions by bytes, but the kernel's work is in the CPU
    left = docs.repartition(n, "bucket").groupBy("bucket")
    return left.cogroup(needed.repartition(n, "into").groupBy("into")).applyInArrow(one, OUT_SCHEMA)


# ------------------------------------------------------------ hot documents
_G_SCHEMA = "doc_id bigint, parts int, gamma array<double>, iters int, done boolean"
#: bytes of a part's packed entries
PART_BYTES = 16 << 10
#: entries per partition of the packed parts
PART_ENTRIES = 500_000


def _mat(col: pa.Array, k: int) -> np.ndarray:
    """Rows of a list column as a matrix of ``k`` columns (-1: as long as they are)."""
    v = col.flatten().to_numpy(zero_copy_only=False)
    return v.reshape(-1, k if k > 0 else len(v) // len(col)) if len(v) else np.zeros((0, max(0, k)))


def part_limit(max_doc_terms: int, k: int, vectors: int) -> int:
    """Entries a part of a hot document holds on average, ``vectors`` K-vectors each."""
    return max(1, min(max_doc_terms, PART_BYTES // (16 + 8 * k * vectors)))


def _entry_type(k: int, vectors: list[str]) -> np.dtype:
    return np.dtype([("t", "i4"), ("w", "i4"), ("c", "f8"), *((v, "f8", (k,)) for v in vectors)])


def _packer(entry: np.dtype, vectors: list[str], k: int):
    """Neighbouring rows of a (document, part) as one row with the packed entries."""

    def rows(keys: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        ends = np.append(at[1:], len(keys))
        blobs = pa.array([rec[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1].astype(np.int32)), blobs], names=["doc_id", "part", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rec = np.zeros((0, 2), np.int64), np.zeros(0, entry)
        for b in batches:
            if b.num_rows == 0:
                continue
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            more = np.empty(b.num_rows, entry)
            for field, name in (("t", "type_id"), ("w", "term_id"), ("c", "cnt")):
                more[field] = col[name].to_numpy(zero_copy_only=False)
            for v in vectors:
                more[v] = _mat(col[v], k)
            key = np.stack([col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "part")], axis=1)
            keys, rec = np.concatenate([keys, key]), np.concatenate([rec, more])
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last:
                yield rows(keys[:last], rec[:last])
                keys, rec = keys[last:], rec[last:]  # may go on in the next batch
        if len(keys):
            yield rows(keys, rec)

    return pack


def hot_estep(entries: DataFrame, hot_docs: DataFrame, alpha, num_types: int, iterations: int, threshold: float, eps: float,
              mode: str, materialize, min_phi: float = 0.0, start=None, eb_bc=None, el_bc=None, type_offsets=None) -> DataFrame:
    """E step for documents too large for one task. ``entries`` holds
    ``(doc_id, parts, type_id, term_id, cnt)`` of the hot documents only, with
    their topic vectors ``eb[, el]`` unless these come as broadcasts; ``hot_docs``
    ``(doc_id, parts)``, the number of parts a document's entries are dealt into.

    The parts are packed once and stay where they are, partitioned and sorted
    by (document, part). Every round sends each part its document's gamma, sums
    ``cnt / phinorm * eb`` per document (the work of one document spreads over
    the whole cluster), updates gamma and writes the documents of the round to
    the checkpoint folder; converged ones take no further part. Nothing passes
    through the driver. ``start``: column of the first gamma (else ones).
    Returns kernel-union rows like :func:`make_kernel`."""
    alpha = np.asarray(alpha, dtype=np.float64)
    k = len(alpha)
    inv_t = 1.0 / num_types
    spark = entries.sparkSession
    vectors = [] if eb_bc is not None else ["eb", "el"] if mode == "bound" else ["eb"]
    entry = _entry_type(k, vectors)
    max_entries = max(1, (32 << 20) // (8 * k))  # ~32 MB per working array

    part = F.pmod(F.xxhash64("type_id", "term_id"), F.col("parts")).cast("int").alias("part")
    dealt = entries.select("doc_id", part, "type_id", "term_id", "cnt", *vectors)
    size = dealt.count()
    slots = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = max(slots, -(-size // PART_ENTRIES))
    by = ("doc_id", "part")
    packed = dealt.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(_packer(entry, vectors, k), "doc_id bigint, part int, packed binary")
    packed = materialize(packed, "hot-parts")
    placed = packed.repartition(n, *by).sortWithinPartitions(*by).persist()

    def sent(docs: DataFrame, parts: DataFrame) -> DataFrame:
        fan = docs.select("doc_id", "parts", "gamma", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
        return fan.join(parts.hint("merge"), list(by), "left").select("doc_id", "part", "parts", "gamma", "packed")

    def unpacked(b: pa.RecordBatch):
        """Pieces of a batch: rows ``lo:hi``, their gamma, entries per row, entries and their eb."""
        gamma = _mat(b.column(3), k)
        blobs = b.column(4).fill_null(b"")
        offs = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
        data = blobs.buffers()[2]
        rec = np.frombuffer(data, entry, (offs[-1] - offs[0]) // entry.itemsize, offs[0]) if offs[-1] > offs[0] else np.zeros(0, entry)
        ends = (offs - offs[0]) // entry.itemsize
        for lo, hi in _sub_ranges(np.diff(ends), max_entries):
            some = rec[ends[lo] : ends[hi]]
            yield lo, hi, gamma[lo:hi], np.diff(ends[lo : hi + 1]), some, looked_up(some, "eb", eb_bc)

    def looked_up(rec: np.ndarray, name: str, bc) -> np.ndarray:
        return rec[name] if bc is None else bc.value[type_offsets[rec["t"].astype(np.int64)] + rec["w"]]

    def weights(gamma, ln, rec, eb):
        et = np.exp(dirichlet_expectation_np(gamma))[np.repeat(np.arange(len(ln)), ln)]
        return et, rec["c"] / (np.einsum("nk,nk->n", et, eb) + eps)

    def contrib(batches):
        for b in batches:
            first = b.column(1).to_numpy(zero_copy_only=False) == 0
            parts = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, gamma, ln, rec, eb in unpacked(b):
                _, w = weights(gamma, ln, rec, eb)
                once = first[lo:hi, None]  # a document's gamma and parts enter its sum with its first part
                vec = np.concatenate([seg_sum(w[:, None] * eb, ln), gamma * once, parts[lo:hi, None] * once], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _vec_array(vec)], names=["doc_id", "vec"])

    def updater(turn: int):
        def update(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                v = _mat(b.column(1), 2 * k + 1)
                g = v[:, k : 2 * k]
                g_new = alpha + np.exp(dirichlet_expectation_np(g)) * v[:, :k] * inv_t
                done = np.mean(np.abs(g_new - g), axis=1) < threshold
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.rint(v[:, 2 * k]).astype(np.int32)), _vec_array(g_new), pa.array(np.full(b.num_rows, turn, np.int32)), pa.array(done)],
                    names=["doc_id", "parts", "gamma", "iters", "done"],
                )

        return update

    first = start if start is not None else F.array_repeat(F.lit(1.0), k)
    active = hot_docs.select("doc_id", "parts", first.alias("gamma"), F.lit(0).alias("iters"), F.lit(False).alias("done"))
    active = materialize(active, "hot-gamma")
    finished = []
    for turn in range(1, iterations + 1):
        s = sum_vectors(sent(active, placed).mapInArrow(contrib, "doc_id bigint, vec array<double>"), ["doc_id"], 2 * k + 1)
        after = materialize(s.select("doc_id", "vec").mapInArrow(updater(turn), _G_SCHEMA), "hot-gamma")
        finished.append(after.where("done"))
        active = after.where("NOT done")
        if active.isEmpty():
            break
    placed.unpersist()
    G = active
    for some in finished:
        G = G.unionByName(some)
    if len(finished) > 1:
        G = materialize(G, "hot-gamma")
    conv = F.col("done")
    gam = G.select(
        F.lit(GAMMA).alias("kind"), "doc_id", F.lit(None).cast("int").alias("type_id"), F.lit(None).cast("int").alias("term_id"),
        F.col("gamma").alias("vec"), "iters", conv.alias("converged"), F.lit(None).cast("bigint").alias("n"),
        F.lit(None).cast("bigint").alias("m"),
    )
    if mode == "gamma":
        return gam

    def final(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, gamma, ln, rec, eb in unpacked(b):
                if not len(rec):
                    continue
                ids = np.repeat(doc[lo:hi], ln)
                t, tm = rec["t"].astype(np.int64), rec["w"].astype(np.int64)
                if mode == "bound":
                    ll = rec["c"] * log_mixture(dirichlet_expectation_np(gamma)[np.repeat(np.arange(len(ln)), ln)], looked_up(rec, "el", el_bc))
                    keys, vals = reduce_rows(ids, np.stack([ll, np.zeros_like(ll)], axis=1))
                    yield _batch(BOUND, len(keys), doc_id=keys, vec=vals)
                    continue
                et, w = weights(gamma, ln, rec, eb)
                nphi = et * w[:, None] * eb
                if mode == "train":
                    keys, vals = reduce_rows((t << 32) | tm, nphi)
                    yield _batch(SSTATS, len(keys), type_id=keys >> 32, term_id=keys & 0xFFFFFFFF, vec=vals)
                else:
                    keep = (nphi >= min_phi).any(axis=1) if min_phi > 0 else np.ones(len(t), dtype=bool)
                    yield _batch(PHI, int(keep.sum()), doc_id=ids[keep], type_id=t[keep], term_id=tm[keep], vec=nphi[keep])

    rows = sent(G, packed).mapInArrow(final, OUT_SCHEMA)
    if mode == "phi":
        return rows.unionByName(gam)
    if mode == "bound":
        def tpart(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                g = _mat(b.column(b.schema.get_field_index("gamma")), k)
                ids = b.column(b.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                tp = theta_part(g, alpha)
                yield _batch(BOUND, len(ids), doc_id=ids, vec=np.stack([np.zeros_like(tp), tp], axis=1))

        return rows.unionByName(G.select("doc_id", "gamma").mapInArrow(tpart, OUT_SCHEMA))
    # train: one statistics row over the hot documents
    def stats(batches):
        acc = np.zeros(k)
        n = m = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            g = _mat(b.column(b.schema.get_field_index("gamma")), k)
            acc += dirichlet_expectation_np(g).sum(axis=0)
            n += b.num_rows
            m += int(np.asarray(b.column(b.schema.get_field_index("done")).to_numpy(zero_copy_only=False)).sum())
        yield _batch(STATS, 1, vec=acc[None, :], n=[n], m=[m])

    return rows.unionByName(G.select("gamma", "done").mapInArrow(stats, OUT_SCHEMA))
