"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's bytes are rolled through a gear hash, ``h = (h << 1) + G[byte]`` on 16
bits, so h depends on the last 16 bytes only. A chunk ends where the top
``CUT_BITS`` bits of h are zero, at least ``MIN_CHUNK`` bytes after the last
cut (after ``MAX_CHUNK`` bytes at the latest) and never inside a character. An
insertion moves the cuts near it only; behind it the same chunks come again.

Passages of ``MIN_SPAN`` bytes are compared (shorter repeats are chance: common
phrases): from every chunk on, and back from every chunk, the fewest whole
chunks of at least that many bytes make a window. Every repeated run of chunks
that is long enough is the union of its windows, whatever single chunks of it
stand elsewhere. Windows are compared by 128-bit digests. Of the places of a
digest the first one, by (id, text, offset), stays; the others, joined where they
touch and lie at the same distance from their first places, make the spans.
Spans with first places in different texts can overlap. Counting and the
search for the first place are partially aggregated, and the join back splits
by size, so a window that a third of all texts hold is no burden.

Defined results: null, empty and shorter texts have no windows; repeats within a text
count; equal texts repeat each other whole; every row is a document of its own,
whatever ids are shared or null (a window of a shared id carries a hash of its
text; of rows equal in id and text one is the first,
the others repeat it whole); a null id ranks first, its spans are
reported too; an empty table gives an empty result;
further columns are ignored (or kept, by ``cut_repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import NON_SPACE, Slice, as_long, mix, slices

CUT_BITS = 5
MIN_CHUNK = 16
MAX_CHUNK = 1024
MIN_SPAN = 100
#: bits of the filter of shared ids
FILTER_BITS = 1 << 24

_GEAR = np.random.default_rng(77).integers(0, 1 << 16, 256).astype(np.uint16)
_SEEDS = [np.random.default_rng(k).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for k in (78, 79)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_roll: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of both bases modulo 2^64."""
    global _roll
    if not _roll or len(_roll[0][0]) < n:
        made = []
        with np.errstate(over="ignore"):
            for base in _BASES:
                pair = []
                for x in (base, pow(base, -1, 1 << 64)):
                    p = np.full(max(n, 1 << 20), x, dtype=np.uint64)
                    p[0] = 1
                    pair.append(np.cumprod(p, dtype=np.uint64))
                made.append(tuple(pair))
        _roll = made
    return _roll


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte; the sum over the last 16 bytes is built
    by doubling the window four times."""
    h = _GEAR[data]
    for k in range(4):
        m = 1 << k
        if len(h) > m:
            h[m:] = h[m:] + (h[:-m] << np.uint16(m))
    return h


def cuts(s: Slice) -> list[np.ndarray]:
    """Chunk ends of each row, as byte positions in the slice."""
    n = len(s.data)
    h = gear_hash(s.data)
    after = np.ones(n, dtype=bool)  # the next byte starts a character
    after[:-1] = (s.data[1:] & 0xC0) != 0x80
    at = np.flatnonzero((h >> np.uint16(16 - CUT_BITS) == 0) & after) + 1
    out = []
    bounds = np.searchsorted(at, s.offs)
    for i in range(len(s.offs) - 1):
        lo, hi = int(s.offs[i]), int(s.offs[i + 1])
        ends, last = [], lo
        for c in at[bounds[i] : bounds[i + 1]].tolist():
            if c - last < MIN_CHUNK or c > hi:
                continue
            while c - last > MAX_CHUNK:
                last = _char_end(s.data, last + MAX_CHUNK, hi)
                ends.append(last)
            if c > last:
                ends.append(c)
                last = c
        while hi - last > MAX_CHUNK:
            last = _char_end(s.data, last + MAX_CHUNK, hi)
            ends.append(last)
        if hi > last:
            ends.append(hi)
        out.append(np.array(ends, dtype=np.int64))
    return out


def _char_end(data: np.ndarray, at: int, hi: int) -> int:
    while at < hi and (data[at] & 0xC0) == 0x80:
        at += 1
    return at


def windows(start: np.ndarray, end: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the windows of at least ``least`` bytes, from
    every chunk on and back from every chunk, each once."""
    chunk = np.arange(len(end))
    last = np.minimum(np.searchsorted(end, start + least), len(end) - 1)
    first = np.maximum(np.searchsorted(start, end - least, "right") - 1, 0)
    on = (end[last] - start >= least) & (row[last] == row)
    back = (end - start[first] >= least) & (row[first] == row)
    pairs = np.unique(np.concatenate([chunk[on] * len(end) + last[on], first[back] * len(end) + chunk[back]]))
    return pairs // max(1, len(end)), pairs % max(1, len(end))


def _slot(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def shared_ids(docs: DataFrame, id_col: str) -> np.ndarray:
    """Bits of a filter of fixed size: those of the ids (null too) that several rows hold."""
    several = docs.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    bits = several.select(_slot("_id").alias("_s")).groupBy(F.floor(F.col("_s") / 64).cast("int").alias("w"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("v")).toArrow()  # at most FILTER_BITS / 64 rows
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return table


def window_rows(docs: DataFrame, text: str, id_col: str, least: int, shared: np.ndarray | None = None) -> DataFrame:
    """``(d1, d2, id, h, start, len, word, words)`` of every window; ``h`` is a
    hash of the text, or 0 where the filter ``shared`` has no bit of the id (such
    an id tells its text, and a hash in every window does not compress); all rows
    of an id are treated alike. ``words`` counts the words that start in the window,
    ``word`` those before it."""

    known = docs.sparkSession.sparkContext.broadcast(shared) if shared is not None else None

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column(0), b.column(1)
            if known is not None:
                at = b.column(3).to_numpy(zero_copy_only=False)
                hit = (known.value[at // 64].view(np.uint64) >> (at % 64).astype(np.uint64)) & np.uint64(1)
                marks = pa.array(np.where(hit.astype(bool), marks.to_numpy(zero_copy_only=False), 0))
            for s in slices(b.column(2)):
                n = len(s.data)
                if not n:
                    continue
                ends = cuts(s)
                row = np.repeat(np.arange(s.lo, s.hi), [len(e) for e in ends])
                end = np.concatenate(ends)
                start = np.zeros_like(end)
                start[1:] = end[:-1]
                a, z = windows(start, end, row, least)
                if not len(a):
                    continue
                start, end, row = start[a], end[z], row[a]
                base = s.offs[row - s.lo]
                inside = NON_SPACE[s.data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                edge = s.offs[:-1][s.offs[:-1] < n]
                first[edge] = inside[edge]  # a text's first word starts with it, whatever stands before in the slice
                count = np.concatenate([[0], np.cumsum(first)])
                digests = []
                with np.errstate(over="ignore"):
                    for table, (up, down) in zip(_SEEDS, _powers(n + 1), strict=True):
                        cum = np.zeros(n + 1, dtype=np.uint64)
                        np.cumsum(table[s.data] * up[:n], out=cum[1:])
                        digests.append(as_long(mix((cum[end] - cum[start]) * down[start] + (end - start).astype(np.uint64))))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, digests), *(c.take(pa.array(row)) for c in (ids, marks)), pa.array(start - base), pa.array((end - start).astype(np.int32)), pa.array((count[start] - count[base]).astype(np.int32)), pa.array((count[end] - count[start]).astype(np.int32))],
                    names=["d1", "d2", "id", "h", "start", "len", "word", "words"],
                )

    key = F.col(id_col).cast("long")
    return docs.select(key.alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"), _slot(key).alias("_s")).mapInArrow(chunks, "d1 bigint, d2 bigint, id bigint, h bigint, start bigint, len int, word int, words int")


def repeated_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_span: int = MIN_SPAN) -> DataFrame:
    """``(id, start_byte, end_byte, n_words, first_id, first_byte)``: spans that
    stood before, in document ``first_id`` from byte ``first_byte`` on."""
    spans = _spans(docs, text, id_col, min_span, shared_ids(docs, id_col))
    # the spans of the second and further equal rows, as often as there are such rows; in two steps, so that no array grows with them
    parts = spans.withColumn("_part", F.explode(F.expr("sequence(0, (rows - 1) div 65536)")))
    each = parts.withColumn("_row", F.explode(F.expr("sequence(1, least(65536, rows - 65536 * _part))")))
    return each.select(F.col("id").alias(id_col), "start_byte", "end_byte", "n_words", F.col("first.id").alias("first_id"), "first_byte")


def _spans(docs: DataFrame, text: str, id_col: str, min_span: int, shared: np.ndarray | None = None) -> DataFrame:
    """Spans ``(id, h, later, rows, start_byte, end_byte, n_words, first,
    first_byte)``. Equal rows give equal windows, which are counted, not kept:
    the first of them (``later`` 0) repeats what stands elsewhere before, the
    others (``later`` 1, ``rows`` of them) repeat it whole."""
    places = window_rows(docs, text, id_col, min_span, shared)
    place = F.struct("id", "h", "start")
    first = places.groupBy("d1", "d2").agg(F.min(place).alias("f"), F.count("*").alias("c"))
    first = first.where("c >= 2").select("d1", "d2", "f")
    again = places.join(first, ["d1", "d2"]).select(
        "id", "h", "start", (F.col("start") + F.col("len")).alias("end"), "word", (F.col("word") + F.col("words")).alias("word_end"),
        F.struct("f.id", "f.h").alias("first"), (F.col("f.start") - F.col("start")).alias("away"), place.eqNullSafe(F.col("f")).alias("own"),
    )
    again = again.groupBy(*again.columns).agg(F.count("*").alias("rows")).where("NOT own OR rows > 1")
    again = again.withColumn("later", F.explode(F.expr("filter(array(IF(own, -1, 0), IF(rows > 1, 1, -1)), x -> x >= 0)")))
    again = again.withColumn("rows", F.expr("IF(later = 1, rows - 1, 1)"))
    span = ["id", "h", "later", "rows", "first", "away"]
    per = Window.partitionBy(*span).orderBy("start", "end")
    reach = F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1))
    spans = again.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("_span", F.sum("_new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*span, "_span").agg(
        F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), (F.max("word_end") - F.min("word")).cast("long").alias("n_words"),
    ).withColumn("first_byte", F.col("start_byte") + F.col("away"))


def cut_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_span: int = MIN_SPAN) -> DataFrame:
    """``docs`` without its repeated spans (only the column ``text`` changes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_i"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"), F.struct("*").alias("_r"))
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "rows")
    key = F.xxhash64("_i", "_h")
    spans = _spans(rows, "_t", "_i", min_span).groupBy("id", "h", "later").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_s"))
    spans = spans.groupBy(F.col("id").alias("_id"), F.col("h").alias("_hash")).agg(*(F.max(F.when(F.col("later") == k, F.col("_s"))).alias(f"_s{k}") for k in (0, 1)))
    spans = spans.withColumn("_key", F.xxhash64("_id", "_hash"))
    lowest = rows.select("_i", "_h", "_at").withColumn("_key", key).groupBy("_key").agg(F.min("_at").alias("_lowest"))
    spans = spans.join(lowest, "_key")
    mine = F.when(F.col("_at") == F.col("_lowest"), F.col("_s0")).otherwise(F.col("_s1"))
    joined = rows.withColumn("_key", key).join(spans, "_key", "left").select("_r.*", mine.alias("_spans"))
    names, at = docs.columns, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at).to_pylist()
            for i, ranges in enumerate(b.column(len(names)).to_pylist()):
                if ranges and values[i]:
                    data, out, pos = values[i].encode(), [], 0
                    for r in ranges:
                        out.append(data[pos : r["start_byte"]])
                        pos = max(pos, r["end_byte"])
                    values[i] = b"".join([*out, data[pos:]]).decode()
            columns = [pa.array(values, b.column(at).type) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)


def op7_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
