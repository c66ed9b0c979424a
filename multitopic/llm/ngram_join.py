"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles (64-bit hashes). Two
documents link when ``100 * intersection >= percent * union``.

1. Equal sets are one node (their digests meet in a partially aggregated
   group-by), so copies never pair up.
2. One global token order: tokens that hold at least 1/HEAVY of all token
   occurrences last (at most HEAVY of them, found in per-block summaries,
   summed on the cluster and broadcast), each part by hash value.
3. A set x may miss at most ``e = floor((100 - percent) |x| / 100)`` tokens.
   Its prefix is extended until the classes make a shared signature certain:
   rare tokens (at most ``rare`` sets hold them) count one each, frequent
   tokens are dealt by hash into small classes and a class with c tokens counts
   c - 1, since two sets that share two tokens of a class share a pair. The
   shortest prefix with a sum of ``e + 1`` suffices (the prefix whose last token
   comes first in the order is inside the other one as far as shared tokens
   go). Class counts depend on the size band; a set indexes its own band and the
   next, and sets within the threshold are at most one band apart.
4. Signatures: single tokens that at least two sets hold, and pairs of tokens
   within a frequent class: about 1.5 e of them at most, whatever the skew.
5. A signature's sets are not paired with each other. In a few star rounds
   each set is verified against one set of the signature's group as long as
   the group has several components; what then is still in different
   components of a group is joined as pairs whose size and bitmap bounds
   (exact upper bounds of the overlap) allow a link, and verified. Groups of
   more than ``HOT`` sets are not joined by their signature but by longer keys
   that take the sizes of both sides into account. Every link
   thus has its ends in one component, and groups of near copies cost one row
   a set. The star hubs differ by round. Between the star rounds a few steps of
   label propagation stand for the components, which are solved after the last
   of them, and once more if the pairs joined then found links.
6. Verification counts the intersection of whole sets.

Defined results: null, empty and wordless texts have the empty set and link
with nothing; fewer words than a shingle make one token; equal sets link; rows
that share an id are linked each by its own text; a null id gives a row
without component; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, materialize, source_path
from .components import connected_components
from .text import NON_SPACE, as_long, mix, shingles, slices, words

#: tokens with at least this share of all token occurrences come last in the order
HEAVY = 200_000
#: occurrences per block of the heavy-token summaries
BLOCK = 1 << 22
#: sets that may hold a rare token
RARE = 64
STARS = 2
#: sets of a signature above which the sizes of both sides enter the key; size bands of these keys
HOT = 64
#: steps of the labels between the rounds
JUMPS = 2
NARROW = 0.02
#: bits of the bitmap bound (sets of more tokens also have a wider bitmap), bits of the candidate filter
BITS = 1024
FILTER_BITS = 1 << 24
_BAND = math.log(1.18)


def allowed_misses(n: int, percent: int) -> int:
    return (100 - percent) * n // 100


def band_of(n: int) -> int:
    """Size band; sets within 85 % of each other are at most one band apart."""
    return int(math.log(n) / _BAND)


def classes_of(band: int, percent: int) -> int:
    """Number of classes that frequent tokens are dealt into."""
    return max(1, allowed_misses(int(math.exp(band * _BAND)), percent) // 2)


def region_size(n: int, percent: int) -> int:
    """Tokens that hold the extended prefix in the worst case."""
    b = band_of(n)
    return min(n, allowed_misses(n, percent) + 1 + max(classes_of(b, percent), classes_of(b + 1, percent)))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for s in slices(batch.column(1)):
        yield s.lo, shingles(words(s, NON_SPACE), size)


def _digest(u: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set."""
    with np.errstate(over="ignore"):
        parts = mix(u + np.uint64(1)), mix(u ^ np.uint64(0x5BD1E9955BD1E995))
        return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in parts)


def _bitmap(u: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmap of ``size`` bits as 64-bit words; the two halves of a
    bitmap, added bit by bit, are the bitmap of half the size."""
    odd = np.bincount((mix(u) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def heavy_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of at most 2 * HEAVY tokens that are in very many texts.
    They only order the prefix; any order gives the same links."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= max(4, n // HEAVY)
            ids = pa.array(as_long(tokens[many]))
            total = pa.array([None], pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([ids, total]), pa.array(np.append(counts[many], n))], names=["token", "n"])

        for batch in batches:
            for _, sets in _sets(batch, size):
                held.extend(sets)
                n += sum(map(len, sets))
                if n >= BLOCK:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    sums = materialize(docs.mapInArrow(summarise, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "heavy")
    total = sums.where("token IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(RARE, total // HEAVY)
    rows = sums.where((F.col("token").isNotNull()) & (F.col("n") >= least)).select("token").toArrow()  # sum of n <= total
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def prefix_regions(docs: DataFrame, size: int, percent: int, heavy) -> DataFrame:
    """``(doc_id, n, d1, d2, bits, region)``: set size, digest of the set,
    parity bitmap and the first tokens in the global order."""

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = heavy.value
        for batch in batches:
            n, d1, d2, bits, wide, lists = [], [], [], [], [], []
            for _, sets in _sets(batch, size):
                for u in sets:
                    n.append(len(u))
                    x, y = _digest(u)
                    d1.append(x)
                    d2.append(y)
                    if len(u) < 6:  # links need an equal set below six tokens
                        bits.append(np.zeros(BITS // 64, np.int64))
                        wide.append(None)
                        lists.append(u[:0])
                        continue
                    bits.append(_bitmap(u, BITS))
                    wide.append(_bitmap(u, 1 << int(len(u) - 1).bit_length()) if len(u) > BITS else None)
                    take = region_size(len(u), percent)
                    if len(hot):
                        late = hot[np.minimum(np.searchsorted(hot, u), len(hot) - 1)] == u
                        u = np.concatenate([u[~late], u[late]])
                    lists.append(u[:take])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))),
                 pa.array(wide, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offs), pa.array(as_long(flat)))],
                names=["doc_id", "n", "d1", "d2", "bits", "wide", "region"],
            )

    return docs.mapInArrow(regions, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bits array<bigint>, wide array<bigint>, region array<bigint>")


def signatures(tokens: DataFrame, percent: int, rare: int) -> DataFrame:
    """``(sig, node)`` from ``(node, n, list)`` with list = array of (at,
    token, df) of the region's tokens held by at least two sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, node = [], []
            offs = batch.column(2).offsets.to_numpy()
            items = batch.column(2).flatten()
            at, token, df = (items.field(k).to_numpy() for k in ("at", "token", "df"))
            base = offs[0]
            for i, (x, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                a, b = offs[i] - base, offs[i + 1] - base
                order = np.argsort(at[a:b], kind="stable")
                got = _document_signatures(at[a:b][order], token[a:b][order].view(np.uint64), df[a:b][order], n, percent, rare)
                sig.append(got)
                node.append(np.full(len(got), x, dtype=np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(sig))), pa.array(np.concatenate(node))], names=["sig", "node"])

    return tokens.select("node", "n", "list").mapInArrow(emit, "sig bigint, node bigint")


def _document_signatures(at: np.ndarray, token: np.ndarray, df: np.ndarray, n: int, percent: int, rare: int) -> np.ndarray:
    """``at`` are positions in the order; positions that are missing hold
    tokens of this set alone, which count like rare ones and need no index."""
    need = allowed_misses(n, percent) + 1
    frequent = df > rare
    out = []
    longest = 0
    with np.errstate(over="ignore"):
        for band in (band_of(n), band_of(n) + 1):
            k = classes_of(band, percent)
            cls = (mix(token) % np.uint64(k)).astype(np.int64)
            members: dict[int, list[int]] = {}
            late = 0  # frequent tokens that do not count: the first of each class
            end = None
            for j in np.flatnonzero(frequent).tolist():
                if int(at[j]) - late >= need:
                    break
                held = members.setdefault(int(cls[j]), [])
                late += not held
                held.append(j)
            end = need + late  # length of the prefix
            longest = max(longest, end)
            for held in members.values():
                for p in range(1, len(held)):
                    x, first = token[held[p]], token[held[:p]]
                    low, high = np.minimum(first, x), np.maximum(first, x)
                    out.append(mix(mix(low + np.uint64(band + 1)) + high))
    single = token[~frequent & (at < longest)]
    return np.concatenate([*out, mix(single)]) if out else mix(single)


def _bitmap_allows(a: str, b: str, percent: int) -> str:
    """Size and bitmap bounds: the sets differ in at least as many tokens as
    their parity bitmaps differ in bits."""
    diff = " + ".join(f"bit_count({a}.w[{k}] ^ {b}.w[{k}])" for k in range(BITS // 64))
    low, high = f"least({a}.n, {b}.n)", f"greatest({a}.n, {b}.n)"
    return f"100 * {low} >= {percent} * {high} AND {100 - percent} * ({a}.n + {b}.n) >= {100 + percent} * ({diff})"


def _wide_allows(a: str, b: str, percent: int):
    """The same with the wider bitmaps (sets within the threshold have bitmaps
    of the same size, or one of twice the other's, which is folded)."""
    size = F.least(F.size(f"{a}.wide"), F.size(f"{b}.wide"))
    half = lambda c: F.when(
        F.size(c) == 2 * size, F.zip_with(F.slice(c, 1, size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    ).otherwise(F.col(c))
    u, v = half(f"{a}.wide"), half(f"{b}.wide")
    diff = F.aggregate(F.zip_with(u, v, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    allowed = F.lit(100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) >= F.lit(100 + percent) * diff
    return F.coalesce((F.size(u) != F.size(v)) | allowed, F.lit(True))


def candidate_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(node, set)`` of the given ``(node, d1, d2)``: a fixed-size bit filter keeps most
    other texts from being worked off, the join drops the rest."""
    slot = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    bits = nodes.select("node").groupBy(F.floor(slot / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(node), {FILTER_BITS}), 64) as int))")).alias("v"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = bits.toArrow()  # at most FILTER_BITS / 64 rows
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_words = known.value
        for batch in batches:
            slot_of = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (filter_words[slot_of // 64].view(np.uint64) >> (slot_of % 64).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            lists = [u for _, got in _sets(batch, size) for u in got]
            d1, d2 = zip(*map(_digest, lists), strict=True) if lists else ((), ())
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(as_long(flat)))], names=["node", "d1", "d2", "set"])

    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot"))
    found = keyed.mapInArrow(sets, "node bigint, d1 bigint, d2 bigint, set array<bigint>")
    out = materialize(found.join(nodes, ["node", "d1", "d2"], "left_semi").select("node", "set").distinct(), "sets")
    known.destroy()
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def link_components(docs: DataFrame, size: int = 4, percent: int = 85, rare: int = RARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of ``docs(doc_id, text)``."""
    if not 85 <= percent <= 100:
        raise ValueError("size bands are laid out for thresholds of 85 to 100 percent")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = spark.sparkContext.broadcast(heavy_tokens(docs, size))
    rows = materialize(prefix_regions(docs, size, percent, heavy), "regions")
    heavy.destroy()
    keyed = rows.where("doc_id IS NOT NULL AND n > 0")
    nodes = keyed.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    nodes = materialize(nodes, "nodes")

    # copies of a set count here, which only moves tokens to the frequent class; their rows end at the semi join
    token = keyed.where("n >= 6").select("doc_id", "n", "d1", F.posexplode("region").alias("at", "token"))
    held = token.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    heads = nodes.where("n >= 6").select(F.col("node").alias("doc_id"), "d1")
    shared = token.join(held, "token").join(heads, ["doc_id", "d1"], "left_semi")
    shared = shared.groupBy(F.col("doc_id").alias("node"), "n", "d1").agg(F.collect_set(F.struct("at", "token", "df")).alias("list"))
    every = materialize(signatures(shared, percent, rare), "sigs")
    several = every.groupBy("sig").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("sig")
    sigs = materialize(every.join(several, "sig", "left_semi"), "sigs")
    drop_path(spark, source_path(every))

    comp = tested = links = None
    solved = True  # whether comp holds the components of all links so far
    for turn in range(STARS + 1):
        if turn == STARS and not solved:
            comp, solved = materialize(connected_components(links), "comp"), True
        info = nodes.select("node", "n", F.col("bits").alias("w"), "wide")
        info = info.withColumn("comp", F.col("node")) if comp is None else info.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        at = sigs.join(info.select("node", "comp"), "node") if comp is not None else sigs.withColumn("comp", F.col("node"))
        hub = F.min("node") if turn == 0 else F.min_by("node", F.xxhash64("node", F.lit(turn)))
        groups = at.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), hub.alias("hub"), F.count("*").alias("held")).where("_lo < _hi")
        if turn < STARS:
            mixed = at.join(groups.select("sig", "hub"), "sig").where("node <> hub")
            pairs = mixed.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(_may_link(pairs, info, percent), "pairs")
        else:
            members = materialize(at.join(groups.select("sig", "held"), "sig"), "members")
            none = F.lit(None).cast("array<bigint>").alias("earlier")
            few = members.where(F.col("held") <= HOT).select(F.col("sig").alias("key"), F.lit(2).alias("side"), "node", none)
            pairs = _across(few, info, percent)
            hot = materialize(members.where(F.col("held") > HOT).select("node").distinct(), "hot")
            if not hot.isEmpty():
                crowd = materialize(_prefix_keys(hot, keyed, nodes, percent), "crowd")
                pairs = pairs.unionByName(_across(crowd, info, percent)).distinct()
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = materialize(ends.join(nodes.select("node", "d1", "d2"), "node"), "ends")
        sets = candidate_sets(docs, ends, size)
        found = materialize(verified(pairs, sets, percent), "links")
        for done in (ends, sets):
            drop_path(spark, source_path(done))
        if not found.isEmpty():
            links, solved = found if links is None else links.unionByName(found), False
            if turn < STARS - 1:
                comp = _labels(links)
    drop_path(spark, source_path(sigs))
    if not solved:
        comp = materialize(connected_components(links), "comp")

    out = rows.select("doc_id", "n", "d1", "d2").join(nodes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"], "left")
    if comp is not None:
        out = out.join(comp, "node", "left").withColumn("node", F.coalesce("comp", "node"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _labels(links: DataFrame) -> DataFrame:
    """``(node, comp)`` by a few steps towards the smallest node that links
    reach: nodes of one label are in one component (but not the reverse), which
    is enough to choose hubs. The last round, which joins pairs, needs components."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    for _ in range(JUMPS):
        up = near.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        after = materialize(near.join(up, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")), "labels")
        drop_path(links.sparkSession, source_path(near))
        near = after
    return near


def _may_link(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that the bounds allow."""
    side = F.struct("comp", "n", "w", "wide")
    p = pairs.join(info.select(F.col("node").alias("a"), side.alias("x")), "a").join(info.select(F.col("node").alias("b"), side.alias("y")), "b")
    return p.where("x.comp <> y.comp").where(_bitmap_allows("x", "y", percent)).where(_wide_allows("x", "y", percent)).select("a", "b")


def _across(members: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of a key's sets in different components that the bounds allow; sets
    of side 0 meet those of side 1, sets of side 2 each other. Sets that share
    one of their ``earlier`` tokens have met there."""
    m = members.join(info, "node")
    left, right = m.alias("x"), m.alias("y")
    sides = "(x.side = 0 AND y.side = 1) OR (x.side = 2 AND x.node < y.node)"
    new = "coalesce(NOT arrays_overlap(x.earlier, y.earlier), true)"
    on = F.expr(f"x.key = y.key AND ({sides}) AND x.comp <> y.comp AND {new} AND {_bitmap_allows('x', 'y', percent)}")
    near = left.join(right, on).where(_wide_allows("x", "y", percent))
    return near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _prefix_keys(hot: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(key, side, node, earlier)``: keys that the linked ones among ``hot`` sets share.

    For the sets of a crowded signature the sizes of both sides count. Sets x
    and y within the threshold share at least p (|x| + |y|) / (100 + p) tokens,
    so their first common token in the global order has at most |x| minus that
    many tokens before it in x, and so in y. Sizes are taken in narrow bands; a
    key is a pair of bands, the set's own and another's (the lower one is side 0,
    the upper one side 1; 2 if they are the same), and a token that low in the
    set. Only bands that hold another set with the token make a key. Texts of one template with more words of their own than the threshold
    allows have only these words so low and share no key. Two sets that share
    many low tokens need to meet at the first of them only, so every row carries
    the set's tokens before its own (at most the set's possible misses)."""
    own = rows.select("doc_id", "d1", "d2", "n", "region").join(nodes.select(F.col("node").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi")
    own = own.join(hot.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    band = F.floor(F.log("n") / NARROW)
    reach = math.ceil(math.log(100 / percent) / NARROW) + 1
    token = own.select(F.col("doc_id").alias("node"), "n", band.alias("band"), F.posexplode("region").alias("at", "token"))
    token = token.where(100 * F.col("at") <= (100 - percent) * F.col("n"))
    token = materialize(token, "crowd-tokens")
    bands = token.groupBy("token", "band").agg(F.count("*").alias("held")).groupBy("token")  # of a token: as many as size bands at most
    bands = bands.agg(F.collect_list(F.struct("band", "held")).alias("_bands"), F.sum("held").alias("_held")).where("_held >= 2").drop("_held")

    def meets(x):
        least = F.exp(x["band"] * NARROW)  # a set of that band has at least so many tokens
        low = (100 + percent) * F.col("at") <= (100 + percent) * F.col("n") - percent * (F.col("n") + least) + 1
        return (F.abs(x["band"] - F.col("band")) <= reach) & ((x["band"] != F.col("band")) | (x["held"] > 1)) & low

    others = F.transform(F.filter("_bands", meets), lambda x: x["band"]).alias("others")
    lists = token.join(bands, "token").select("node", "band", "at", "token", others).groupBy("node", "band").agg(F.sort_array(F.collect_list(F.struct("at", "token", "others"))).alias("_list"))
    each = lists.select("node", "band", F.col("_list.token").alias("_tokens"), F.posexplode("_list").alias("_pos", "_one"))
    other = each.select("node", "band", "_one.token", F.expr("slice(_tokens, 1, _pos)").alias("earlier"), F.explode("_one.others").alias("other"))
    key = F.xxhash64(F.least("band", "other"), F.greatest("band", "other"), "token").alias("key")
    side = F.when(F.col("band") < F.col("other"), 0).when(F.col("band") > F.col("other"), 1).otherwise(2).alias("side")
    held = materialize(other.select(key, side, "node", "earlier"), "crowd-keys")
    meet = held.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("n > 1 AND (lo = 2 OR lo < hi)")
    return held.join(meet.select("key"), "key", "left_semi")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

