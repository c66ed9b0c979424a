"""Hard-negative mining with Kronecker-packed products.

Scores are integer inner products. Components become integers ``floor(256 x)``;
all of them plus a bias are non-negative, so the components of several
candidates fit side by side, as fields, into one wide integer. A field is as
wide as the largest possible inner product of biased vectors, so fields never
run into each other: one multiplication per anchor component advances the
scores of all candidates of a word at once, and taking the fields apart and
subtracting the bias terms gives the exact scores.

A word of up to 53 bits is carried in a double, where products and sums of
such integers are exact and the multiplications of a block are one matrix
product. Where one field alone is wider (huge components), words are Python
integers of any width and the same code runs on these.

Two passes read the written integer vectors: the first finds each anchor's
positives, the second, for every (anchor, positive), the best rows of other
labels within the score band. Anchors go out in shards of at most
``SHARD_BYTES`` (of their vectors, held and broadcast one at a time), each
against all rows in blocks; a task keeps the first rows of every anchor over
its blocks, and Spark merges the tasks' lists by rank. Equal vectors of a label
within a block are scored once, with as many of their smallest ids as a list can hold.

Defined results: rows with a null label, a null vector, or any null or
non-finite component take no part; a vector that is shorter than another counts
as zero there (an empty one scores 0); components and scores beyond a long
count as the nearest long; every row counts by itself, also among equal rows or
ids, and an anchor is no candidate of its own; a null id is no anchor and comes last
among equal scores; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_path, materialize, scratch_path, source_path
from .vectors import is_finite, scaled

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: a negative scores at least LOW and at most HIGH percent of the positive
LOW, HIGH = 30, 90
SHARD_BYTES = 16 << 20
#: numbers in the largest temporary arrays of a block
CELLS = 1 << 21
#: bits of a double that hold integers exactly
EXACT = 53
_LONG = np.iinfo(np.int64)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(row, id, label, v)`` of the rows that take part; ``row`` tells rows of
    the written table apart."""
    return vectors.where(F.col(label).isNotNull() & is_finite(embedding)).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        scaled(embedding, SCALE).alias("v"),
    )


class Fields:
    """Layout of the fields: bias, width and the number type of words.

    ``limit`` bounds the size of every component and ``dims`` the number of
    components of every vector.
    """

    def __init__(self, limit: int, dims: int):
        self.bias, self.dims = int(limit), max(1, dims)
        self.width = max(1, (self.dims * (2 * self.bias) ** 2).bit_length())
        self.exact = self.width <= EXACT
        self.type = np.float64 if self.exact else object
        self.fields = EXACT // self.width if self.exact else 8

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """Biased vectors as rows; missing components are zero."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offs = lists.offsets.to_numpy()
        size = np.diff(offs)
        flat = lists.flatten().to_numpy()
        if not self.exact:
            flat = flat.astype(object)
        out = np.full((len(size), self.dims), self.bias, dtype=self.type)
        if len(flat):
            place = np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)
            out[np.repeat(np.arange(len(size)), size), place] = flat + self.bias
        return out

    def pack(self, biased: np.ndarray) -> np.ndarray:
        """Candidates as rows to words: components x words; a word holds the
        candidates at k, k + words, k + 2 words, ..."""
        words = -(-len(biased) // self.fields)
        out = np.zeros((words, self.dims), dtype=self.type)
        for f in range(self.fields):
            part = biased[f * words : (f + 1) * words]
            out[: len(part)] += part * self.type_of(1 << (f * self.width))
        return out.T

    def type_of(self, x: int):
        return float(x) if self.exact else x

    def unpack(self, products: np.ndarray, n: int) -> np.ndarray:
        """Anchors x words to anchors x candidates."""
        parts = []
        if self.exact:
            products = products.astype(np.int64)
        for f in range(self.fields):
            parts.append((products >> (f * self.width)) & ((1 << self.width) - 1))
        return np.concatenate(parts, axis=1)[:, :n]

    def scores(self, anchors: np.ndarray, words: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Exact inner products of biased anchors with the packed candidates,
        whose biased component sums are ``sums``."""
        fields = self.unpack(anchors @ words, len(sums))
        mine = anchors.sum(1)[:, None]
        if not self.exact:
            out = fields - self.bias * (mine + sums[None, :]) + self.dims * self.bias**2
            return np.clip(out, int(_LONG.min), int(_LONG.max)).astype(np.int64)
        fields -= (self.bias * (mine + sums[None, :])).astype(np.int64)
        fields += self.dims * self.bias**2
        return fields


class FirstRows:
    """The first rows of every list, over all blocks seen: higher scores, then
    smaller ids."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.held = [np.zeros(0, np.int64)] * 5  # list, score, whether the id is null, id, row
        self.new: list[list[np.ndarray]] = []
        self.floor = np.full(lists, _LONG.min)
        self.count = 0

    def add(self, *columns: np.ndarray) -> None:
        self.new.append(list(columns))
        self.count += len(columns[0])
        if self.count > max(CELLS // 8, len(self.held[0])):
            self.prune()

    def prune(self) -> None:
        columns = [np.concatenate(x) for x in zip(self.held, *self.new, strict=True)]
        which, score, none, ids, row = columns
        order = np.lexsort((row, ids, none, ~score, which))  # ~score falls as score rises, without overflow
        which = which[order]
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.zeros(0, np.int64)
        rank = np.arange(len(which)) - np.repeat(first, np.diff(first, append=len(which)))
        keep = order[rank < self.size]
        self.held = [x[keep] for x in columns]
        self.new, self.count = [], 0
        which, score = self.held[:2]
        full = np.bincount(which, minlength=len(self.floor)) == self.size
        self.floor[:] = _LONG.min
        last = np.flatnonzero(np.append(which[1:] != which[:-1], True)) if len(which) else np.zeros(0, np.int64)
        at = last[full[which[last]]]
        self.floor[which[at]] = score[at]


def _collapse(vectors: np.ndarray, label: np.ndarray, none: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows of a block to score: of equal vectors of one label the ``most``
    smallest ids (the others come after them in every list)."""
    if len(ids) <= most:
        return np.arange(len(ids))
    _, text = np.unique(np.array([hash(v.tobytes()) if vectors.dtype != object else hash(tuple(v)) for v in vectors]), return_inverse=True)
    order = np.lexsort((ids, none, label, text))
    # equal hashes are compared, so only truly equal neighbours form a group
    a, b = order[1:], order[:-1]
    same = (text[a] == text[b]) & (label[a] == label[b])
    at = np.flatnonzero(same)
    same[at] = (vectors[a[at]] == vectors[b[at]]).all(axis=1)
    first = np.flatnonzero(np.append(True, ~same))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return np.sort(order[rank < most])


def first_rows(vectors: DataFrame, shared, size: int, same: bool) -> DataFrame:
    """``(list, score, none, id, row, rank)``: the first rows of every list.

    ``shared`` broadcasts the layout and, as arrays, the shard's ``matrix``
    (biased vectors), ``row`` and ``label``, and of every list its ``anchor``
    (position, in ascending order), ``low`` and ``high`` score. Candidates have
    the anchor's label (``same``) or another."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, a = shared.value
        best = FirstRows(len(a["anchor"]), size)
        step = max(1, min(2048, CELLS // layout.dims))
        lists = max(1, CELLS // step)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, label = part.column(0).to_numpy(), part.column(2).to_numpy()
                none = part.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = part.column(1).fill_null(0).to_numpy()
                biased = layout.matrix(part.column(3))
                # one row more than a list holds: the anchor may be among them
                keep = _collapse(biased, label, none, ids, size + 1)
                biased, row, label, none, ids = biased[keep], row[keep], label[keep], none[keep], ids[keep]
                words, sums = layout.pack(biased), biased.sum(1)
                for lo in range(0, len(a["anchor"]), lists):
                    mine = a["anchor"][lo : lo + lists]
                    used, back = np.unique(mine, return_inverse=True)
                    score = layout.scores(a["matrix"][used], words, sums)[back]
                    fits = (a["label"][mine][:, None] == label[None, :]) == same
                    fits &= score >= np.maximum(a["low"][lo : lo + lists], best.floor[lo : lo + lists])[:, None]
                    fits &= score <= a["high"][lo : lo + lists][:, None]
                    if same:
                        fits &= a["row"][mine][:, None] != row[None, :]
                    i, j = np.nonzero(fits)
                    best.add(i + lo, score[i, j], none[j], ids[j], row[j])
        best.prune()
        if len(best.held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held], names=names)

    names = ["list", "score", "none", "id", "row"]
    found = vectors.select("row", "id", "label", "v").mapInArrow(scan, ", ".join(f"{c} bigint" for c in names))
    per = Window.partitionBy("list").orderBy(F.col("score").desc(), "none", "id", "row")
    return found.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= size)


def _shards(anchors: DataFrame, layout: Fields, shard_bytes: int) -> Iterator[pa.Table]:
    """The anchors ``(row, label, v)`` in shards of bounded size, one at a time."""
    per = max(1, shard_bytes // (8 * layout.dims))
    total = anchors.count()
    shards = max(1, -(-total // per))
    cuts = anchors.approxQuantile("row", [k / shards for k in range(1, shards)], 0.25 / shards) if shards > 1 else []
    ends = [None, *cuts, None]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        part = anchors
        if lo is not None:
            part = part.where(F.col("row") > int(lo))
        if hi is not None:
            part = part.where(F.col("row") <= int(hi))
        # quantiles are approximate: a shard may hold up to 1.5 times its share
        yield part.select("row", "id", "label", "v").orderBy("row").toArrow()


def mine_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # scoring a row costs as much as there are anchors, so rows are dealt evenly first
    rows = materialize(integer_vectors(vectors, vec_id, embedding, label).repartition(n), "vectors")
    # the absolute value of the smallest long is no long
    limit, dims = rows.agg(
        F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(20,0)")), F.abs(F.array_min("v").cast("decimal(20,0)")))), F.max(F.size("v"))
    ).first()
    layout = Fields(int(limit or 0), int(dims or 0))
    anchors = materialize(rows.where(F.col("id") % anchor_every == 0), "anchors")
    path = scratch_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    send = spark.sparkContext.broadcast
    for shard in _shards(anchors, layout, shard_bytes):
        if not shard.num_rows:
            continue
        held = {"matrix": layout.matrix(shard.column("v")), "row": shard.column("row").to_numpy(), "label": shard.column("label").to_numpy()}
        every = np.arange(shard.num_rows)
        shared = send((layout, held | {"anchor": every, "low": np.full(len(every), _LONG.min), "high": np.full(len(every), _LONG.max)}))
        near = first_rows(rows, shared, positives, True).orderBy("list", "rank").toArrow()  # at most positives rows an anchor
        shared.destroy()
        if not near.num_rows:
            continue
        at, score = near.column("list").to_numpy(), near.column("score").to_pylist()
        band = [[min(max(x, int(_LONG.min)), int(_LONG.max)) for x in (-(-low * p // 100), high * p // 100)] for p in score]
        shared = send((layout, held | {"anchor": at, "low": np.array([b[0] for b in band]), "high": np.array([b[1] for b in band])}))
        far = first_rows(rows, shared, negatives, False)
        id_of = F.when(F.col("none") == 0, F.col("id"))
        pairs = pa.table({"list": np.arange(len(at)), "anchor_id": shard.column("id").take(at), "none": near.column("none"), "id": near.column("id"), "positive_score": near.column("score")})
        pairs = spark.createDataFrame(pairs).select("list", "anchor_id", id_of.alias("positive_id"), "positive_score")
        # at most positives rows an anchor of the shard
        out = far.select("list", "rank", id_of.alias("negative_id"), F.col("score").alias("negative_score")).join(F.broadcast(pairs), "list")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        shared.destroy()
    for table in (rows, anchors):
        drop_path(spark, source_path(table))
    return spark.read.schema(schema).parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", "embedding", label.alias("label")))


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.r, b.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
