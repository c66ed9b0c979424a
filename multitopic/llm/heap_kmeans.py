"""Centroid clustering (k-means) with heap-ordered bounds, exact in integers.

Components become integers ``floor(1024 x)``; distances are squared Euclidean
ones and a centroid is the componentwise ``floor(sum / count)``, so results are
exact and independent of partitioning.

The vectors are written once as blocks of at most ``BLOCK`` of them. In each
block every cluster keeps a heap of its vectors, ordered by the gap between
the lower bound of a vector's distance to all other centroids and the upper
bound to its own. When centroids move, a gap shrinks by at most its own
centroid's drift plus the largest drift of the others; instead of lowering all
gaps, the cluster's accumulated drift is an offset: a gap is stored with the
offset of its time added, and has expired when the stored value is no longer
above the cluster's present offset. Only the expired ones are popped, scanned
exactly against all centroids (ties: smaller number) and pushed again; the rest
of the heap is not looked at. Bounds are kept a little tighter than floating
point needs, so rounding can only cause a scan, never save one.

A round is one job without a shuffle: it reads the blocks, pops, and writes the
blocks with the changes of the sums (moved vectors only); the changes, k rows of
sums a block, are added up by Spark and only k sums and counts reach the driver. A
lost task is run again from the blocks of the round before. When no centroid
moves, the remaining rounds would change nothing and are left out.

Defined results: a vector that is null, has another number of components, or
any null or non-finite one is left out (no row); components and distances
beyond a long count as the nearest long; rows with equal or null ids are vectors of their own
(a null id is last among the starts); fewer vectors than centroids start as many
clusters as there are vectors; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, materialize, source_path
from .vectors import is_finite, scaled

SCALE = 1024
DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SALT = "3:"
BLOCK = 4096
#: relative tightening of the bounds
SLACK = 1e-9
_MAX = np.iinfo(np.int64).max

_FIELDS = {
    "ids": pa.binary(), "none": pa.binary(), "vectors": pa.binary(), "cluster": pa.binary(),
    "keys": pa.binary(), "heap": pa.binary(), "change": pa.list_(pa.decimal128(38, 0)),
}
_SCHEMA = "ids binary, none binary, vectors binary, cluster binary, keys binary, heap binary, change array<decimal(38,0)>"


class Space:
    """Number type in which distances of components up to ``limit`` are exact."""

    def __init__(self, limit: int, dims: int):
        self.exact = dims * (2 * limit) ** 2 < 1 << 53
        self.type = np.float64 if self.exact else object
        self.store = np.int16 if limit < 1 << 15 else np.int32 if limit < 1 << 31 else np.int64

    def numbers(self, stored: np.ndarray) -> np.ndarray:
        return stored.astype(self.type)

    def distances(self, x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
        """Exact squared distances, vectors x centroids."""
        c = np.array(centroids, dtype=self.type).reshape(len(centroids), -1)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


class Block:
    """A block's vectors, their clusters, and one heap a cluster."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.vectors, self.cluster, self.heaps = vectors, cluster, heaps

    @classmethod
    def fresh(cls, vectors: np.ndarray, k: int) -> Block:
        """No vector is in a cluster yet: all are due in the first round."""
        block = cls(vectors, np.full(len(vectors), -1, dtype=np.int32), [[] for _ in range(k)])
        block.due = list(range(len(vectors)))
        return block

    @classmethod
    def read(cls, row: dict, dims: int, k: int, store: type) -> Block:
        vectors = np.frombuffer(row["vectors"], dtype=store).reshape(-1, dims)
        cluster = np.frombuffer(row["cluster"], dtype=np.int32).copy()
        keys, members = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["heap"], dtype=np.int32).tolist()
        ends = np.cumsum(np.bincount(cluster, minlength=k)).tolist()
        pairs = list(zip(keys, members, strict=True))  # written in heap order
        return cls(vectors, cluster, [pairs[a:b] for a, b in zip([0, *ends], ends, strict=False)])

    def expired(self, offsets: list[float]) -> np.ndarray:
        """Pops the vectors whose gap no longer covers their cluster's drift."""
        out = self.__dict__.pop("due", [])
        for heap, offset in zip(self.heaps, offsets, strict=True):
            while heap and heap[0][0] <= offset:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, dtype=np.int64)

    def assign(self, space: Space, centroids: list[list[int]], offsets: list[float]) -> np.ndarray:
        """Rescans the expired vectors; changes of (count, sums) per cluster."""
        k, dims = len(centroids), self.vectors.shape[1]
        due = self.expired(offsets)
        wide = object if not space.exact else np.int64
        change = np.zeros((k, dims + 1), dtype=wide)
        if not len(due):
            return change
        far = space.distances(space.numbers(self.vectors[due]), centroids)
        best = far.argmin(1)  # the first of equal ones
        near = far[np.arange(len(due)), best]
        far[np.arange(len(due)), best] = math.inf
        upper, lower = np.sqrt(near.astype(float)), np.sqrt(far.min(1).astype(float))
        gap = np.where(np.isinf(lower), math.inf, lower - upper - SLACK * (np.where(np.isinf(lower), 0, lower) + upper))
        for i, c, g in zip(due.tolist(), best.tolist(), gap.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g + offsets[c], i))
        before = self.cluster[due]
        moved = before != best
        full = np.ones((int(moved.sum()), dims + 1), dtype=wide)
        full[:, 1:] = self.vectors[due[moved]]
        np.add.at(change, best[moved], full)
        was = before[moved] >= 0
        np.subtract.at(change, before[moved][was], full[was])
        self.cluster[due] = best
        return change

    def row(self, ids: bytes, none: bytes, change: np.ndarray) -> dict:
        entries = [e for heap in self.heaps for e in heap]
        return {
            "ids": ids, "none": none, "vectors": self.vectors.tobytes(), "cluster": self.cluster.tobytes(),
            "keys": np.array([e[0] for e in entries], dtype=np.float64).tobytes(), "heap": np.array([e[1] for e in entries], dtype=np.int32).tobytes(),
            "change": [Decimal(int(x)) for x in change.ravel()],
        }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _FIELDS.items()], names=list(_FIELDS))


def first_blocks(rows: DataFrame, space: Space, centroids: list[list[int]]) -> DataFrame:
    """Blocks of ``rows(id, v)`` after the first assignment."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(space.store)
                block = Block.fresh(vectors, len(centroids))
                change = block.assign(space, centroids, [0.0] * len(centroids))
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield _batch([block.row(part.column(0).fill_null(0).to_numpy().tobytes(), none.tobytes(), change)])

    return rows.select("id", "v").mapInArrow(build, _SCHEMA)


def next_blocks(blocks: DataFrame, space: Space, centroids: list[list[int]], offsets: list[float]) -> DataFrame:
    """The blocks after a further assignment."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block.read(row, len(centroids[0]), len(centroids), space.store)
                yield _batch([block.row(row["ids"], row["none"], block.assign(space, centroids, offsets))])

    return blocks.mapInArrow(advance, _SCHEMA)


def final_rows(blocks: DataFrame, space: Space, centroids: list[list[int]], offsets: list[float]) -> DataFrame:
    """``(id, cluster, distance)`` after the last assignment."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block.read(row, len(centroids[0]), len(centroids), space.store)
                block.assign(space, centroids, offsets)
                away = space.numbers(block.vectors) - np.array(centroids, dtype=space.type)[block.cluster]
                distance = (away * away).sum(1)
                distance = np.minimum(distance, _MAX if not space.exact else math.inf).astype(np.int64)
                ids = pa.array(np.frombuffer(row["ids"], dtype=np.int64), mask=np.frombuffer(row["none"], dtype=bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(block.cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(finish, "id bigint, cluster int, distance bigint")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in _FIELDS if c != "change"}


class Means:
    """The driver's k sums and counts, centroids and accumulated drifts."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.sums = [[0] * (len(c) + 1) for c in centroids]
        self.offsets = [0.0] * len(centroids)

    def update(self, blocks: DataFrame) -> bool:
        """Adds up the blocks' changes and moves the centroids; False if none moved."""
        width = len(self.centroids[0]) + 1
        total = blocks.select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        for at, x in total.collect():  # k * (components + 1) rows
            self.sums[at // width][at % width] += int(x)
        new = [[s // n for s in row] if n else old for old, (n, *row) in zip(self.centroids, self.sums, strict=True)]
        drift = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + SLACK) for x, y in zip(self.centroids, new, strict=True)]
        for j in range(len(new)):
            self.offsets[j] += drift[j] + max([d for i, d in enumerate(drift) if i != j], default=0.0)
        self.centroids = new
        return any(drift)


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``
    of every vector of ``dims`` components."""
    spark = vectors.sparkSession
    rows = vectors.where((F.size(embedding) == dims) & is_finite(embedding)).select(F.col(vec_id).cast("bigint").alias("id"), scaled(embedding, scale).alias("v"))
    schema = f"`{vec_id}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last()
    starts = [list(r.v) for r in rows.orderBy(by_hash, "v").limit(clusters).collect()]
    if not starts:
        return spark.createDataFrame([], schema)
    high, low = rows.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    space = Space(max(high, -low), dims)
    means = Means(starts)
    blocks = materialize(first_blocks(rows, space, starts), "kmeans")
    for k in range(rounds):
        if not means.update(blocks) or k == rounds - 1:
            break
        old = blocks
        blocks = materialize(next_blocks(old, space, means.centroids, means.offsets), "kmeans")
        drop_path(spark, source_path(old))
    out = materialize(final_rows(blocks, space, means.centroids, means.offsets), "clusters")
    drop_path(spark, source_path(blocks))
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means.centroids]
    sums = [(c, min(x, int(_MAX)), min(sum(inertia.values()), int(_MAX)), digest[c]) for c, x in inertia.items()]
    known = spark.createDataFrame(sums, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = out.join(F.broadcast(known), "cluster")  # k rows
    return joined.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(
            f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d "
            f"FROM (SELECT v.r, c.c, CAST({square} AS BIGINT) AS d FROM v, c{t} c) GROUP BY r)"
        )
        if t < ROUNDS:
            steps.append(
                f"c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM c{t} o LEFT JOIN (SELECT c, list(m ORDER BY place) AS q FROM ("
                f"SELECT c, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m "
                f"FROM (SELECT a.c, unnest(v.q) AS x, unnest(range({DIMS})) AS place FROM a{t} a JOIN v ON v.r = a.r) GROUP BY c, place) GROUP BY c) n ON n.c = o.c)"
            )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
     FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS INTEGER) AS c, q
     FROM (SELECT sha256('{SALT}' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {CLUSTERS})),
{', '.join(steps)}
SELECT v.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(c.q, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN c{ROUNDS} c ON c.c = a.c
"""


ORACLE = _oracle()
