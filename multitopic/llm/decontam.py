"""Benchmark decontamination with a generalised suffix automaton.

The test items' words become one generalised suffix automaton (all items are
inserted into the same automaton). Training words are streamed through it;
after each word the automaton knows the longest suffix of the stream that
occurs in some item. Where that length reaches ``window`` words (or covers a
whole item of fewer words), the matched words are hit. Before streaming, a
vectorised test leaves out words that cannot be part of such a match: every
two neighbouring words of a match are neighbours in some item.

The automaton goes to the executors as a broadcast. Items are cut into shards
of at most ``SHARD_WORDS`` words (checked by summing word counts on the
cluster), so its size is bounded; one pass is made per shard and the spans of
all passes are merged per document, before anything is decided or cut. An item longer than a shard is cut into
pieces that overlap by ``window - 1`` words, which keeps all its windows.

Words are maximal runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased.

Defined results: null or wordless documents have no hits; null or wordless
items match nothing; equal items are all named; repeated rows give repeated
rows; a null item id counts as an item but is left out of the id list; empty
documents give an empty result, no items give no hits; further columns are
ignored (or kept, by ``remove_spans``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import ALNUM, Slice, Words, slices, words

WINDOW = 10
SHARD_WORDS = 100_000


class ItemAutomaton:
    """Generalised suffix automaton over word ids, with the items that each
    window-long (or whole short-item) substring stands in."""

    def __init__(self, items: list[tuple[int, np.ndarray, bool]], window: int):
        """``items``: (item number, word hashes, whether it is a whole item)."""
        self.window = window
        every = np.unique(np.concatenate([h for _, h, _ in items])) if items else np.zeros(0, np.uint64)
        self.vocab = every
        self.size = max(1, len(every))
        ids = [np.searchsorted(every, h) for _, h, _ in items]
        pairs = [x[:-1] * self.size + x[1:] for x in ids if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.next: dict[int, int] = {}
        self.link, self.len = [-1], [0]
        edges: list[list[int]] = [[]]
        for x in ids:
            last = 0
            for c in x.tolist():
                last = self._extend(last, c, edges)
        self.shortest = min([window, *(len(x) for x in ids)])
        found, whole = defaultdict(set), defaultdict(set)
        for (number, _, complete), x in zip(items, ids, strict=True):
            at = 0
            for c in x.tolist():
                at = self.next[at * self.size + c]
                if self.len[at] >= window:
                    found[self._state_of(at, window)].add(number)
            if complete and len(x) < window:
                whole[self._state_of(at, len(x))].add((number, len(x)))
        self.found = {k: sorted(v) for k, v in found.items()}
        self.whole = {k: sorted(v) for k, v in whole.items()}
        up: dict[int, int] = {}  # nearest state on the way to the root that ends a short item
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__) if whole else ():
            up[v] = v if v in whole else up.get(self.link[v], 0)
        self.up = up

    def _extend(self, last: int, c: int, edges: list[list[int]]) -> int:
        nxt, link, length, size = self.next, self.link, self.len, self.size
        q = nxt.get(last * size + c)
        if q is not None and length[q] == length[last] + 1:
            return q
        cur = -1
        if q is None:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append([])
            p = last
            while p != -1 and p * size + c not in nxt:
                nxt[p * size + c] = cur
                edges[p].append(c)
                p = link[p]
            if p == -1:
                return cur
            q = nxt[p * size + c]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
        else:
            p = last
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        edges.append(list(edges[q]))
        for d in edges[q]:
            nxt[clone * size + d] = nxt[q * size + d]
        link[q] = clone
        if cur != -1:
            link[cur] = clone
        while p != -1 and nxt.get(p * size + c) == q:
            nxt[p * size + c] = clone
            p = link[p]
        return clone if cur == -1 else cur

    def _state_of(self, v: int, n: int) -> int:
        """The state holding the suffix of length ``n`` of state ``v``'s strings."""
        link, length = self.link, self.len
        while length[link[v]] >= n:
            v = link[v]
        return v

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges [a, b) of a run of word ids, and the items met."""
        nxt, link, length, size, window = self.next, self.link, self.len, self.size, self.window
        v = n = 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for j, c in enumerate(ids, 1):
            q = nxt.get(v * size + c)
            while q is None and v:
                v = link[v]
                n = length[v]
                q = nxt.get(v * size + c)
            if q is None:
                n = 0
                continue
            v, n = q, n + 1
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                items.update(self.found.get(u, ()))
                spans.append((j - window, j))
            if self.up:
                u = self.up[v]
                while u:
                    for number, m in self.whole[u]:
                        if m <= n:
                            items.add(number)
                            spans.append((j - m, j))
                    u = self.up.get(link[u], 0)
        return spans, items

    def scan(self, s: Slice, w: Words) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """``(row, hit word ranges, items)`` of the rows of a slice with hits."""
        if not len(self.vocab) or not len(w.hash):
            return
        ids = np.searchsorted(self.vocab, w.hash)
        ids[ids == len(self.vocab)] = 0
        known = self.vocab[ids] == w.hash
        joined = np.zeros(len(ids), dtype=bool)  # the word continues a possible match
        if len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1]) + 1
            code = ids[both - 1] * self.size + ids[both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[both[self.pairs[at] == code]] = True
            joined[w.rows[:-1][w.rows[:-1] < len(ids)]] = False
        begin = np.flatnonzero(known & ~joined)
        stops = np.append(np.flatnonzero(~joined), len(ids))
        end = stops[np.searchsorted(stops, begin, "right")]
        long = end - begin >= self.shortest
        row_of = np.searchsorted(w.rows, begin[long], "right") - 1
        by_row: dict[int, tuple[list, set]] = {}
        for row, a, b in zip(row_of.tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
            spans, items = self.stream(ids[a:b].tolist())
            if spans:
                base = a - int(w.rows[row])
                got = by_row.setdefault(row, ([], set()))
                got[0].extend((base + x, base + y) for x, y in spans)
                got[1].update(items)
        for row, (spans, items) in by_row.items():
            yield row, merge_spans(spans), items


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def hash_words(text: str | None) -> np.ndarray:
    got = [words(s, ALNUM).hash for s in slices(pa.array([text or ""], pa.string()))]
    return got[0] if got else np.zeros(0, np.uint64)


def shard_items(benchmark: DataFrame, text: str, id_col: str, window: int, shard_words: int) -> list[DataFrame]:
    """The items in shards of at most ``shard_words`` words. Word counts are
    bounded by (characters + 1) / 2 and summed on the cluster in id order."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    if total <= shard_words:
        return [items]
    parts = F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")
    cut = items.select("item", parts.alias("w")).where(F.size("w") > 0)
    step = max(window, shard_words // 2)
    cut = cut.select(
        "item", F.size("w").alias("n"),
        F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"greatest(size(w) - {window}, 0)"), F.lit(step)), lambda i: F.slice("w", i + 1, step + window - 1))).alias("w"),
    )
    cut = cut.select("item", "n", F.array_join("w", " ").alias("text"), F.size("w").alias("m"))
    run = Window.orderBy("item", "text").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("shard", F.floor(F.sum("m").over(run) / F.lit(max(1, shard_words // 2)))).persist()
    shards = [r[0] for r in cut.select("shard").distinct().orderBy("shard").collect()]
    return [cut.where(F.col("shard") == k).select("item", "text", "n") for k in shards]


def build_automaton(shard: DataFrame, window: int) -> tuple[ItemAutomaton, list[str | None]]:
    """The automaton of a size-checked shard and the ids of its items."""
    rows = shard.collect()
    names = sorted({(r["item"] is None, r["item"] or "") for r in rows})
    number = {x: k for k, x in enumerate(names)}
    items = []
    for r in rows:
        h = hash_words(r["text"])
        if len(h):
            items.append((number[(r["item"] is None, r["item"] or "")], h, "n" not in shard.columns or r["n"] <= len(h)))
    return ItemAutomaton(items, window), [None if null else x for null, x in names]


def _hits(docs: DataFrame, machine, keep: list[str], text: str) -> DataFrame:
    """Per document: ``keep`` columns, n_words, spans (word ranges), items."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = machine.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            spans: list = [[] for _ in range(batch.num_rows)]
            items: list = [[] for _ in range(batch.num_rows)]
            for s in slices(batch.column(batch.schema.get_field_index("_text"))):
                w = words(s, ALNUM)
                n_words[s.lo : s.hi] = np.diff(w.rows)
                for row, ranges, met in automaton.scan(s, w):
                    spans[s.lo + row] = [{"a": a, "b": b} for a, b in ranges]
                    items[s.lo + row] = [names[k] if names[k] is not None else "\u0000" for k in sorted(met)]
            span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(n_words), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_words", "spans", "items"])

    inner = docs.select(*keep, F.col(text).alias("_text"))
    return inner.mapInArrow(scan, ", ".join([*fields, "n_words bigint", "spans array<struct<a:bigint,b:bigint>>", "items array<string>"]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id",
    window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(id, n_words, spans, items)`` per document; spans are merged word
    ranges [a, b), items the ids (as strings) with an occurring window."""
    sc = docs.sparkSession.sparkContext
    shards = shard_items(benchmark, text, item_col, window, shard_words)
    if len(shards) == 1:
        return _hits(docs, sc.broadcast(build_automaton(shards[0], window)), [id_col], text)
    keyed = docs.select(id_col, text, F.xxhash64(F.col(id_col), F.col(text)).alias("_row"), F.lit(1).alias("_one"))
    parts = [_hits(keyed, sc.broadcast(build_automaton(s, window)), [id_col, "_row", "_one"], text) for s in shards]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p.withColumn("_one", F.lit(0)))
    merged = every.groupBy(id_col, "_row").agg(
        F.max("n_words").alias("n_words"), F.sum("_one").alias("_times"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (m, x) -> CASE WHEN size(m) > 0 AND x.a <= element_at(m, -1).b "
        "THEN concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, x.b)))) "
        "ELSE concat(m, array(x)) END)"
    )
    return merged.select(id_col, "n_words", joined.alias("spans"), "items", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).drop("col")


def contamination_report(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    found = find_contamination(docs, benchmark, text, id_col, **kw)
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.b - x.a)")
    ids = F.array_join(F.array_sort(F.filter("items", lambda x: x != "\u0000")), ",")
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
    )


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.5, item_col: str = "item_id",
    window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` without the hit words: matched spans are cut out, and the text
    is scanned again until nothing is left (a cut may bring words together).
    Documents of which more than ``max_coverage`` of the words are hit in the
    first scan of all shards are dropped; the number of shards changes nothing. Only the column ``text`` changes."""
    sc = docs.sparkSession.sparkContext
    machines = [sc.broadcast(build_automaton(x, window)) for x in shard_items(benchmark, text, item_col, window, shard_words)]
    if len(machines) > 1:
        return _remove_sharded(docs, machines, text, max_coverage)
    (machine,) = machines

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = machine.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            changed: dict[int, str | None] = {}
            for s in slices(column):
                w = words(s, ALNUM)
                for row, ranges, _ in automaton.scan(s, w):
                    total = int(w.rows[row + 1] - w.rows[row])
                    if sum(b - a for a, b in ranges) > max_coverage * total:
                        changed[s.lo + row] = None
                    else:
                        changed[s.lo + row] = _cut(automaton, s, w, row, ranges)
            if changed:
                values = column.to_pylist()
                for i, t in changed.items():
                    values[i] = t
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, column.type))
                drop = [i for i, t in changed.items() if t is None]
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[drop] = False
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(clean, docs.schema)


def _remove_sharded(docs: DataFrame, machines: list, text: str, max_coverage: float) -> DataFrame:
    """``remove_spans`` over several shards: in every round all shards scan the
    same texts, their spans are merged and cut together, and the texts that
    were cut are scanned again. A text is known by its 128-bit digest."""
    todo = docs.select(F.md5(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    done = []
    while True:
        hits = [_text_hits(todo, m) for m in machines]
        every = hits[0]
        for h in hits[1:]:
            every = every.unionByName(h)
        # equal texts have equal spans in a shard
        spans = every.groupBy("_key").agg(F.max("_n").alias("_n"), F.flatten(F.collect_set("_spans")).alias("_spans"))
        texts = todo.join(spans, "_key").dropDuplicates(["_key"])
        cut = materialize(_cut_texts(texts, None if done else max_coverage), "decontam-round")
        if cut.isEmpty():
            break
        done.append(cut)
        todo = cut.where("_text IS NOT NULL")
    if not done:
        return docs
    last = done[0]
    for cut in done[1:]:
        newer = cut.select(F.col("_key"), F.col("_text").alias("_newer"))
        last = last.join(newer, "_key", "left").select("_key", F.coalesce("_newer", "_text").alias("_text"))
    row = docs.select(F.struct("*").alias("_row"), F.md5(F.col(text)).alias("_key"))
    joined = row.join(last.select("_key", F.col("_text").alias("_new"), F.lit(True).alias("_hit")), "_key", "left").where("_hit IS NULL OR _new IS NOT NULL")
    return joined.select(F.col("_row").withField(f"`{text}`", F.coalesce("_new", F.col("_row")[text])).alias("_row")).select("_row.*")


def _text_hits(texts: DataFrame, machine) -> DataFrame:
    """``(_key, _n, _spans)`` of the texts with hits in one shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = machine.value
        for batch in batches:
            at, n, spans = [], [], []
            for s in slices(batch.column(1)):
                w = words(s, ALNUM)
                for row, ranges, _ in automaton.scan(s, w):
                    at.append(s.lo + row)
                    n.append(int(w.rows[row + 1] - w.rows[row]))
                    spans.append([{"a": a, "b": b} for a, b in ranges])
            if at:
                span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(spans, span_type)], names=["_key", "_n", "_spans"])

    return texts.mapInArrow(scan, "_key string, _n bigint, _spans array<struct<a:bigint,b:bigint>>")


def _cut_texts(texts: DataFrame, max_coverage: float | None) -> DataFrame:
    """``(_key, _text)`` without the hit words; null where more than
    ``max_coverage`` of the words are hit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, total, spans in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                ranges = merge_spans((x["a"], x["b"]) for x in spans)
                if max_coverage is not None and sum(b - a for a, b in ranges) > max_coverage * total:
                    out.append(None)
                else:
                    (s,) = slices(pa.array([t]))
                    out.append(_without(s, words(s, ALNUM), 0, ranges).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_key", "_text"])

    return texts.select("_key", "_text", "_n", "_spans").mapInArrow(cut, "_key string, _text string")


def _cut(automaton: ItemAutomaton, s: Slice, w: Words, row: int, ranges) -> str:
    while True:
        data = _without(s, w, row, ranges)
        s, row = next(iter(slices(pa.array([data], pa.binary())))), 0
        w = words(s, ALNUM)
        left = list(automaton.scan(s, w))
        if not left:
            return data.decode("utf-8")
        ranges = left[0][1]


def _without(s: Slice, w: Words, row: int, ranges) -> bytes:
    """The bytes of a row without the words of ``ranges``."""
    data, base, first = s.row(row).tobytes(), int(s.offs[row]), int(w.rows[row])
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at : int(w.start[first + a]) - base])
        at = int(w.end[first + b - 1]) - base
    return b"".join([*out, data[at:]])


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contamination_report(read("documents"), read("benchmark")).drop("spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i + 1, i + least(10, len(w))), ' ') AS g, least(10, len(w)) AS m
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i + 1, i + m), ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
