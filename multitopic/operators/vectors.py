"""Element-wise sums of K-vectors per key.

Up to ``WIDE`` topics the vectors are K scalar sums of one hash aggregation:
JVM-side, partial and final. A plan with thousands of aggregates outgrows code
generation, so wider vectors are added up in blocks of rows by NumPy: every task
first reduces its own rows to at most ``TASK_BYTES`` of vectors at a time (the
partial sums), one shuffle brings the rows of a key together in order, and the
final pass adds neighbouring rows of a key while it streams over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import reduce_rows

WIDE = 256
TASK_BYTES = 32 << 20


def sum_vectors(df: DataFrame, keys: list[str], k: int, col: str = "vec", out: str = "vec") -> DataFrame:
    """``(keys..., out)`` with the sum of ``col`` over the rows of a key; at most
    two integer keys, of which the first of two and the second fit 31 bits."""
    if k <= WIDE:
        return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(col)[i]) for i in range(k)]).alias(out))
    key = F.lit(0).cast("bigint")
    if len(keys) == 1:
        key = F.col(keys[0]).cast("bigint")
    elif keys:
        key = F.shiftleft(F.col(keys[0]).cast("bigint"), 32) + F.col(keys[1])
    rows = df.where(F.col(col).isNotNull()).select(key.alias("_key"), F.col(col).alias("_vec"))
    some = rows.mapInArrow(_partial(k), "_key bigint, _vec array<double>")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = some.repartition(n, "_key").sortWithinPartitions("_key").mapInArrow(_final(k), "_key bigint, _vec array<double>")
    types = {f.name: f.dataType for f in df.schema}
    if len(keys) == 2:
        parts = [F.shiftright("_key", 32).cast(types[keys[0]]).alias(keys[0]), F.expr("_key & 4294967295").cast(types[keys[1]]).alias(keys[1])]
    else:
        parts = [F.col("_key").cast(types[c]).alias(c) for c in keys]
    return done.select(*parts, F.col("_vec").alias(out))


def _rows(keys: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * vectors.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=["_key", "_vec"])


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, TASK_BYTES // (8 * k))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, k)


def _partial(k: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, TASK_BYTES // (8 * k))
        keys, vectors = np.zeros(0, np.int64), np.zeros((0, k))
        for key, vec in _blocks(batches, k):
            keys, vectors = reduce_rows(np.concatenate([keys, key]), np.concatenate([vectors, vec]))
            if len(keys) > most:
                yield _rows(keys, vectors)
                keys, vectors = keys[:0], vectors[:0]
        if len(keys):
            yield _rows(keys, vectors)

    return add


def _final(k: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors = np.zeros(0, np.int64), np.zeros((0, k))
        for key, vec in _blocks(batches, k):
            # rows come by key: all but the last key are complete
            keys, vectors = reduce_rows(np.concatenate([keys, key]), np.concatenate([vectors, vec]))
            if len(keys) > 1:
                yield _rows(keys[:-1], vectors[:-1])
                keys, vectors = keys[-1:], vectors[-1:]
        if len(keys):
            yield _rows(keys, vectors)

    return add
