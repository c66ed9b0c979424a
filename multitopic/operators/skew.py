"""Equi-joins of a large table (corpus entries) to a keyed table (one row
per term: vocabulary, exp E[log beta]) with hot keys split off.

A term that occurs in a third of all documents would send a third of the
corpus to one reducer of a shuffle join. Such keys are known in advance
from the vocabulary's ``doc_freq`` (rows per term), so they are split off
before the join: their few keyed rows are broadcast (size counted first)
and joined map-side, all other keys go through the shuffle join. At most
``partitions`` keys can be hot (their doc_freq sum is at most the total),
which bounds what is broadcast. Results equal the plain join; the split
only changes where rows are joined. AQE's skew-join splitting remains as a
second line for skew the vocabulary does not show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(vocab: DataFrame, keys: list[str], partitions: int) -> DataFrame | None:
    """Keys whose rows alone exceed one reducer's share of the corpus
    (``doc_freq > total / partitions``); None when the vocabulary carries
    no ``doc_freq`` or no key is hot."""
    if "doc_freq" not in vocab.columns:
        return None
    total = vocab.agg(F.sum("doc_freq")).collect()[0][0] or 0
    limit = max(1, total // max(1, partitions))
    hot = vocab.where(F.col("doc_freq") > F.lit(limit)).select(*keys)
    return hot if hot.limit(1).count() else None


def frequent_keys(vocab: DataFrame, keys: list[str], row_bytes: Column, limit_bytes: int) -> DataFrame | None:
    """The most frequent keys, by powers of two of ``doc_freq``, that take at
    most ``limit_bytes`` together; None when there are none."""
    if "doc_freq" not in vocab.columns:
        return None
    power = F.floor(F.log2("doc_freq")).cast("int")
    sizes = vocab.groupBy(power.alias("p")).agg(F.sum(row_bytes).alias("b")).collect()  # at most 63 rows
    least, size = None, 0
    for p, b in sorted(map(tuple, sizes), reverse=True):
        size += b
        if size > limit_bytes:
            break
        least = p
    return vocab.where(power >= least).select(*keys) if least is not None else None


def split_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, row_bytes: Column,
               limit_bytes: int) -> DataFrame:
    """Inner join ``big`` ⋈ ``small`` on ``keys`` (``small`` unique per key)
    with the ``hot`` keys joined against a broadcast of their ``small``
    rows. Falls back to the plain join when there is no hot key or their
    counted size exceeds ``limit_bytes``."""
    if hot is None:
        return big.join(small, keys)
    from ..session import materialize

    hot_small = materialize(small.join(F.broadcast(hot), keys, "left_semi"), "hot-keys")
    size = hot_small.agg(F.sum(row_bytes)).collect()[0][0] or 0
    if size == 0 or size > limit_bytes:
        return big.join(small, keys)
    hot_part = big.join(F.broadcast(hot_small), keys)
    cold_part = big.join(F.broadcast(hot_small.select(*keys)), keys, "left_anti").join(small, keys)
    return hot_part.unionByName(cold_part)
