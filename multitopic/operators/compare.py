"""Topic difference of two models (C4, J3-J5, F-8..F-12, U1-U3, K7, A18).

Topic vectors are the per-type row-normalised lambdas concatenated over
the types (so each sums to T, D11). The two models' per-term rows are
joined 1:1 on (type_id, term_id) -- their vocabularies must be equal -- and
every task turns its block of terms into K1 x K2 partial matrices with NumPy
(``P^T Q``-style products), which are then summed per topic1. Nothing ever
emits one row per (term, topic1, topic2); the only K1 x K2-sized data is the
result itself.

* kullback_leibler: sum p ln(p / q) with both vectors normalised first;
* hellinger: sqrt(1/2 sum (sqrt p - sqrt q)^2), no normalisation;
* jensen_shannon: 1/2 KL(p, m) + 1/2 KL(q, m), m = (p + q) / 2 (normalising);
* jaccard: 1 - |A & B| / |A | B| on the top-word sets (empty union -> 1);
* rescale_dot: (x.y - d_min) / (d_max - d_min) with d_max / d_min the dot
  products of the sorted vectors in the same / opposite order; the sorted
  positions come from a distributed range sort, joined on rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.corpus import dense_index
from .estep import _mat, _vec_array
from .topics import topic_wordsets

DISTANCES = ("kullback_leibler", "hellinger", "jaccard", "jensen_shannon", "rescale_dot")

# user-registered measures: name -> fn(m1, m2) -> DataFrame(topic1, topic2, z)
CUSTOM: dict = {}


def register_distance(name: str, fn) -> None:
    """Add a named measure to :func:`diff` (2.12 registry). ``fn(m1, m2)``
    returns ``(topic1, topic2, z)`` for all cells."""
    CUSTOM[name] = fn

_PART_SCHEMA = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("topic1", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))]
)


def _partials(parts: tuple[str, ...], k1: int, k2: int, sp=None, sq=None, block: int = 4_000_000):
    """mapInArrow function over rows (p ARRAY[K1], q ARRAY[K2]) emitting one
    K1 x K2 (or K1 x 1; for ``sumq`` 1 x K2) partial per part and task."""
    sp = None if sp is None else np.asarray(sp, dtype=np.float64)
    sq = None if sq is None else np.asarray(sq, dtype=np.float64)

    def fn(batches):
        shape = {"plogp": (k1, 1), "sump": (k1, 1), "sumq": (1, k2)}
        acc = {p: np.zeros(shape.get(p, (k1, k2))) for p in parts}
        for b in batches:
            if b.num_rows == 0:
                continue
            P = _mat(b.column(b.schema.get_field_index("p")), k1)
            Q = _mat(b.column(b.schema.get_field_index("q")), k2)
            if "dot" in acc:
                acc["dot"] += P.T @ Q
            if "plogq" in acc:
                acc["plogq"] += P.T @ np.log(Q)
            if "plogp" in acc:
                acc["plogp"][:, 0] += (P * np.log(P)).sum(axis=0)
            if "sump" in acc:
                acc["sump"][:, 0] += P.sum(axis=0)
            if "sumq" in acc:
                acc["sumq"][0] += Q.sum(axis=0)
            if "hel" in acc:
                rp, rq = np.sqrt(P), np.sqrt(Q)
                step = max(1, block // max(1, k1 * k2))
                for lo in range(0, len(P), step):
                    gap = rp[lo : lo + step, :, None] - rq[lo : lo + step, None, :]
                    acc["hel"] += np.einsum("nij,nij->ij", gap, gap)
            if "js" in acc:
                pn, qn = P / sp, Q / sq
                sm = 0.5 * (sp[:, None] + sq[None, :])
                step = max(1, block // max(1, k1 * k2))
                for lo in range(0, len(P), step):
                    a = pn[lo : lo + step, :, None]
                    c = qn[lo : lo + step, None, :]
                    m = 0.5 * (P[lo : lo + step, :, None] + Q[lo : lo + step, None, :]) / sm[None]
                    acc["js"] += (a * np.log(a / m)).sum(axis=0) + (c * np.log(c / m)).sum(axis=0)
        for p, mat in acc.items():
            n = mat.shape[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * n), pa.array(np.arange(n, dtype=np.int32)), _vec_array(mat)], names=["part", "topic1", "vec"]
            )

    return fn


def _sum_parts(rows: DataFrame, width_of) -> dict[str, DataFrame]:
    """All parts summed in ONE aggregation over (part, topic1); every part's
    table is a filter of it, so the kernel pass and its shuffle run once per
    query (the exchange is reused) instead of once per part."""
    w = max(width_of.values())
    agg = rows.groupBy("part", "topic1").agg(F.array(*[F.sum(F.get(F.col("vec"), i)) for i in range(w)]).alias("vec"))
    return {
        part: agg.where(F.col("part") == part).select("topic1", F.slice("vec", 1, width).alias("vec"))
        for part, width in width_of.items()
    }


def _grid(spark, k1: int, k2: int, diagonal: bool) -> DataFrame:
    """All (topic1, topic2) cells, or the diagonal: K1*K2 rows from a range
    (the result's own size), never a cross join of data."""
    if diagonal:
        return spark.range(k1).select(F.col("id").cast("int").alias("topic1"), F.col("id").cast("int").alias("topic2"))
    return spark.range(k1 * k2).select(
        (F.col("id") / k2).cast("int").alias("topic1"), F.pmod(F.col("id"), F.lit(k2)).cast("int").alias("topic2")
    )


def _matrix(parts: dict[str, DataFrame], name: str) -> DataFrame:
    return parts[name].select("topic1", F.posexplode("vec").alias("topic2", name))


def _vector(parts: dict[str, DataFrame], name: str, key: str = "topic1") -> DataFrame:
    return parts[name].select(F.col("topic1").alias(key), F.col("vec")[0].alias(name))


def _joined(m1, m2) -> DataFrame:
    a = m1.topic_term_dists().select("type_id", "term_id", "p")
    b = m2.topic_term_dists().select("type_id", "term_id", F.col("p").alias("q"))
    return a.join(b, ["type_id", "term_id"])


def _check_vocab(m1, m2):
    """Both models must number the same words the same way."""
    if list(m1.num_terms) == list(m2.num_terms):
        if m1.vocab is m2.vocab:
            return
        keys = ["type_id", "term_id", "term"]
        if not m1.vocab.select(*keys).join(m2.vocab.select(*keys), keys, "left_anti").limit(1).count():
            return
    raise ValueError("topic vectors can be compared only over one vocabulary; these models differ in theirs")


def _diagonal(m1, m2, distance: str) -> DataFrame:
    """The K cells (k, k) of a measure that is a sum over terms: K sums per
    partition (JVM-side), no K x K block."""
    k = m1.k
    wide = _joined(m1, m2)
    one = lambda e: F.array(*[F.sum(F.expr(e.format(p=f"p[{i}]", q=f"q[{i}]"))) for i in range(k)])
    if distance == "hellinger":
        sums = wide.agg(one("pow(sqrt({p}) - sqrt({q}), 2)").alias("h"))
        cells = sums.select(F.posexplode(F.transform("h", lambda x: F.sqrt(0.5 * x))).alias("topic1", "z"))
    elif distance == "kullback_leibler":
        sums = wide.agg(one("{p} * ln({p} / {q})").alias("d"), one("{p}").alias("sp"), one("{q}").alias("sq"))
        cells = sums.select(F.posexplode(F.arrays_zip("d", "sp", "sq")).alias("topic1", "x")).select(
            "topic1", (F.col("x.d") / F.col("x.sp") - F.log("x.sp") + F.log("x.sq")).alias("z")
        )
    else:  # jensen_shannon: the normalisers first
        sums = wide.agg(one("{p}").alias("sp"), one("{q}").alias("sq"))
        mean = "(({p} + {q}) / (sp[{i}] + sq[{i}]))"
        e = lambda i: (
            f"p[{i}] / sp[{i}] * ln(p[{i}] / sp[{i}] / {mean}) + q[{i}] / sq[{i}] * ln(q[{i}] / sq[{i}] / {mean})".format(p=f"p[{i}]", q=f"q[{i}]", i=i)
        )
        row = sums.collect()[0]  # 2K numbers
        lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
        both = wide.withColumns({"sp": lit(row["sp"]), "sq": lit(row["sq"])})
        cells = both.agg(F.array(*[0.5 * F.sum(F.expr(e(i))) for i in range(k)]).alias("d")).select(F.posexplode("d").alias("topic1", "z"))
    return cells.select("topic1", F.col("topic1").alias("topic2"), "z")


def rescale_dot_parts(m1, m2) -> dict[str, DataFrame]:
    """Sorted-order dot products: rank every topic's values with a range
    sort, pivot the ranks to one row per rank (K values), join the two models
    on rank (d_max) and on reversed rank (d_min)."""
    k1, k2 = m1.k, m2.k
    n = int(sum(m1.num_terms))

    def ranked(m, col):
        lp = m.topic_term_dists().select(F.posexplode("p").alias("topic", "v"))
        idx = dense_index(lp, ["topic", "v"], "_g")
        start = idx.groupBy("topic").agg(F.min("_g").alias("_s"))
        r = idx.join(F.broadcast(start), "topic").select("topic", (F.col("_g") - F.col("_s")).alias("rank"), "v")
        k = m.k
        return r.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("topic", "v"))).alias("_a")).select(
            "rank", F.transform("_a", lambda x: x["v"]).alias(col)
        ), k

    x, _ = ranked(m1, "p")
    y, _ = ranked(m2, "q")
    same = x.join(y, "rank").select("p", "q")
    rev = x.join(y.select((F.lit(n - 1) - F.col("rank")).alias("rank"), "q"), "rank").select("p", "q")
    dmax = _sum_parts(same.mapInArrow(_partials(("dot",), k1, k2), _PART_SCHEMA), {"dot": k2})["dot"]
    dmin = _sum_parts(rev.mapInArrow(_partials(("dot",), k1, k2), _PART_SCHEMA), {"dot": k2})["dot"]
    return {"dmax": dmax, "dmin": dmin}


def diff(m1, m2, distance: str = "kullback_leibler", num_words: int = 30, n_ann_terms: int = 10, diagonal: bool = False,
         annotation: bool = True, normed: bool = True) -> DataFrame:
    """C4: ``(topic1, topic2, z[, pos, neg])``."""
    from ..plans.model import TopicModel

    if distance not in DISTANCES and distance not in CUSTOM:
        raise ValueError(f"no measure named '{distance}'; there are {', '.join([*DISTANCES, *CUSTOM])}")
    if not isinstance(m2, TopicModel) or not isinstance(m1, TopicModel):
        raise TypeError("both models must be TopicModel instances")
    k1, k2 = m1.k, m2.k
    if diagonal and k1 != k2:
        raise ValueError(f"diagonal=True pairs topic i with topic i, but there are {k1} and {k2} topics")
    _check_vocab(m1, m2)
    spark = m1.spark
    grid = _grid(spark, k1, k2, diagonal)
    ws1 = ws2 = None
    if distance == "jaccard" or annotation:
        ws1 = topic_wordsets(m1, num_words).select(F.col("topic").alias("topic1"), F.col("words").alias("w1"))
        ws2 = topic_wordsets(m2, num_words).select(F.col("topic").alias("topic2"), F.col("words").alias("w2"))

    if distance in CUSTOM:
        z = grid.join(CUSTOM[distance](m1, m2).select("topic1", "topic2", "z"), ["topic1", "topic2"])
    elif distance == "jaccard":
        g = grid.join(F.broadcast(ws1), "topic1", "left").join(F.broadcast(ws2), "topic2", "left")
        inter = F.size(F.array_intersect(F.coalesce("w1", F.array()), F.coalesce("w2", F.array())))
        uni = F.size(F.array_union(F.coalesce("w1", F.array()), F.coalesce("w2", F.array())))
        z = g.select("topic1", "topic2", F.when(uni == 0, F.lit(1.0)).otherwise(1.0 - inter / uni).alias("z"))
    elif diagonal and distance != "rescale_dot":
        z = _diagonal(m1, m2, distance)
    else:
        wide = _joined(m1, m2)
        if distance == "kullback_leibler":
            parts = _sum_parts(wide.mapInArrow(_partials(("plogq", "plogp", "sump", "sumq"), k1, k2), _PART_SCHEMA),
                               {"plogq": k2, "plogp": 1, "sump": 1, "sumq": k2})
            z = (
                _matrix(parts, "plogq")
                .join(_vector(parts, "plogp"), "topic1")
                .join(_vector(parts, "sump"), "topic1")
                .join(parts["sumq"].select(F.posexplode("vec").alias("topic2", "sumq")), "topic2")
                .select(
                    "topic1", "topic2",
                    ((F.col("plogp") - F.col("plogq")) / F.col("sump") - F.log("sump") + F.log("sumq")).alias("z"),
                )
            )
        elif distance == "hellinger":
            parts = _sum_parts(wide.mapInArrow(_partials(("hel",), k1, k2), _PART_SCHEMA), {"hel": k2})
            z = _matrix(parts, "hel").select("topic1", "topic2", F.sqrt(0.5 * F.col("hel")).alias("z"))
        elif distance == "jensen_shannon":
            sp_rows = wide.agg(*[F.sum(F.col("p")[i]) for i in range(k1)], *[F.sum(F.col("q")[j]) for j in range(k2)]).collect()[0]
            sp, sq = np.array(sp_rows[:k1], dtype=float), np.array(sp_rows[k1:], dtype=float)
            parts = _sum_parts(wide.mapInArrow(_partials(("js",), k1, k2, sp, sq), _PART_SCHEMA), {"js": k2})
            z = _matrix(parts, "js").select("topic1", "topic2", (0.5 * F.col("js")).alias("z"))
        else:  # rescale_dot
            parts = _sum_parts(wide.mapInArrow(_partials(("dot",), k1, k2), _PART_SCHEMA), {"dot": k2})
            rd = rescale_dot_parts(m1, m2)
            dmax = rd["dmax"].select("topic1", F.posexplode("vec").alias("topic2", "dmax"))
            dmin = rd["dmin"].select("topic1", F.posexplode("vec").alias("topic2", "dmin"))
            z = (
                _matrix(parts, "dot").join(dmax, ["topic1", "topic2"]).join(dmin, ["topic1", "topic2"])
                .select("topic1", "topic2", F.try_divide(F.col("dot") - F.col("dmin"), F.col("dmax") - F.col("dmin")).alias("z"))
            )
        z = grid.join(z, ["topic1", "topic2"])
    if normed:
        from ..session import materialize

        z = materialize(z, "diff")  # K1 x K2 cells, read twice
        mx = z.agg(F.max("z")).collect()[0][0]
        if mx is not None and abs(mx) > 1e-8:
            z = z.select("topic1", "topic2", (F.col("z") / F.lit(float(mx))).alias("z"))
    if annotation:
        g = z.join(F.broadcast(ws1), "topic1", "left").join(F.broadcast(ws2), "topic2", "left")
        a = F.coalesce("w1", F.array().cast("array<string>"))
        b = F.coalesce("w2", F.array().cast("array<string>"))
        pos = F.slice(F.array_sort(F.array_intersect(a, b)), 1, n_ann_terms)
        neg = F.slice(F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a))), 1, n_ann_terms)
        z = g.select("topic1", "topic2", "z", pos.alias("pos"), neg.alias("neg"))
    return z
