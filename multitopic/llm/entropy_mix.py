"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``total_share`` of all words; a target stops at ``max_copies`` times its
source's words, the excess going to the others by weight (water filling).

Entropy balancing: document rates r_i nearest to 1 in relative entropy,
subject to ``sum_i r_i size_i = target`` per source and ``r_i <= max_copies``.
The convex dual has one multiplier per source and the rates are exponentially
tilted, ``r_i = min(max_copies, exp(lambda_s size_i / mean_s))``. Newton steps
on the dual (kept inside a bracket) run as Spark aggregations over the exact
histogram of sizes per source; the state is one row per source, written after
each step. Multipliers are rounded to 9 decimals, so the order in which sums
arrive changes no result.

Rates become copies by error diffusion: documents of a source are dealt by
hash into groups of about ``group_rows``; within a group, from long to short,
each takes floor or ceiling of its rate, whichever keeps the words taken next
to the words wanted. What is left over is about one short document a group.

Defined results: null text or no words: size 0, nothing taken; null source is
a source of its own; repeated ids and equal rows count as rows of their own;
no words at all: targets 0; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: parts that every source's documents are dealt into for the join with their source's row
SALTS = 64


def word_count(text: str = "text"):
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def source_targets(hist: DataFrame, total_share: float, max_copies: float, weights=WEIGHTS) -> DataFrame:
    """``(_src, source_size, n_docs, target)`` from ``(_src, size, n)``. The
    windows without a partition run over one row per source."""
    per = hist.groupBy("_src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    per = per.withColumn("_at", F.row_number().over(Window.orderBy("_src"))).withColumn("_w", w)
    per = per.withColumn("_cap", F.lit(float(max_copies)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", "_src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.lit(float(total_share)) * F.sum("source_size").over(every)
    per = per.withColumn("_level", (wanted - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(left))
    per = per.withColumn("_fit", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_src", "_level"))).over(every))
    return per.select(
        "_src", "source_size", "n_docs", F.least("_cap", F.coalesce(F.col("_fit._level") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def solve_dual(hist: DataFrame, targets: DataFrame, max_copies: float, max_steps: int = 60, tol: float = 1e-9) -> DataFrame:
    """``(_src, lam, mean)``: ``lam`` is null where every rate is at the bound
    (target at the cap) or no word is wanted."""
    log_cap = math.log(max_copies)
    edges = hist.where("size > 0").groupBy("_src").agg(F.min("size").alias("_least"))
    state = targets.join(edges, "_src").select(
        "_src", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), "_least", F.col("source_size").alias("_all")
    ).where(F.col("target") > 0)
    state = state.where(F.col("target") < F.lit(float(max_copies)) * F.col("_all")).select(
        "_src", "target", "mean", F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), (F.lit(log_cap) * F.col("mean") / F.col("_least")).alias("hi"), F.lit(1.0).alias("gap"),
    )
    state = materialize(state, "dual")
    hist = hist.where("size > 0")
    for _ in range(max_steps):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(log_cap)))
        words = F.col("n") * F.col("size")
        sums = hist.join(state, "_src").groupBy("_src").agg(
            F.sum(words * tilt).alias("_v"), F.sum(F.when(F.col("lam") * x < log_cap, words * x * tilt).otherwise(F.lit(0.0))).alias("_d")
        )
        s = state.join(sums, "_src")
        over = F.col("_v") > F.col("target")
        s = s.withColumn("hi", F.when(over, F.least("hi", "lam")).otherwise(F.col("hi")))
        s = s.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.greatest("lo", "lam")))
        step = F.when(F.col("_d") > 0, F.col("lam") + (F.col("target") - F.col("_v")) / F.col("_d"))
        inside = step.isNotNull() & (step < F.col("hi")) & (F.col("lo").isNull() | (step > F.col("lo")))
        halved = F.when(F.col("lo").isNotNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("hi") * 2 - 1)
        gap = F.abs(F.col("_v") - F.col("target")) / F.col("target")
        done = gap <= tol
        state = materialize(
            s.select("_src", "target", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise(halved).alias("lam"), "lo", "hi", gap.alias("gap")),
            "dual",
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tol:
            break
    return state.select("_src", F.round("lam", 9).alias("lam"), "mean")


def document_rates(docs: DataFrame, total_share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """``docs`` needs ``_src``, ``size`` and a hash ``_key``; adds source_size,
    target, n_docs, rate."""
    hist = materialize(docs.groupBy("_src", "size").agg(F.count("*").alias("n")), "sizes")
    targets = materialize(source_targets(hist, total_share, max_copies), "targets")
    dual = solve_dual(hist, targets, float(max_copies))
    per_source = targets.join(dual, "_src", "left")
    rate = (
        F.when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("lam").isNull(), F.lit(float(max_copies)))
        .otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(max_copies)))))
    )
    # a source may hold a third of all rows: its row is copied once per salt, its documents are dealt by salt
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = docs.withColumn("_salt", F.pmod(F.col("_key"), F.lit(SALTS)))
    return dealt.join(salted, ["_src", "_salt"]).withColumn("rate", rate).drop("lam", "mean", "_salt")


def round_rates(rated: DataFrame, key: str, max_copies: int, group_rows: int = 1024) -> DataFrame:
    """Adds ``copies``; ``key`` names a hash that orders documents of equal size."""
    groups = F.pmod(F.col(key), F.ceil(F.col("n_docs") / F.lit(group_rows)))
    cols = [c for c in rated.columns if c not in ("size", key, "rate")]
    item = F.struct((-F.col("size")).alias("neg"), F.col(key).alias(key), "size", "rate", F.struct(*cols).alias("row"))
    packed = rated.groupBy("_src", groups.alias("_g")).agg(F.sort_array(F.collect_list(item)).alias("_list"))
    fold = (
        "aggregate(_list, named_struct('err', 0D, 'out', cast(array() as array<int>)), (a, x) -> "
        "named_struct('err', a.err + (x.rate - {c}) * x.size, 'out', concat(a.out, array({c}))), a -> a.out)"
    ).format(c=f"cast(least({max_copies}, greatest(floor(x.rate), least(ceil(x.rate), floor(x.rate + a.err / greatest(x.size, 1) + 0.5D)))) as int)")
    opened = packed.select(F.explode(F.arrays_zip(F.col("_list").alias("_list"), F.expr(fold).alias("copies"))).alias("_z"))
    return opened.select("_z._list.row.*", "_z._list.size", "_z._list.rate", "_z.copies")


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", total_share: float = 1.5, max_copies: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, rate, copies,
    taken, and the columns ``keep`` of ``docs``."""
    src = F.coalesce(F.concat(F.lit("\u0001"), F.col(source).cast("string")), F.lit("\U0010ffff"))
    sized = docs.select(
        F.col(id_col).alias(id_col), F.col(source).alias("source"), src.alias("_src"), word_count(text).alias("size"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("_key"), *keep,
    )
    rated = document_rates(materialize(sized, "sized"), total_share, max_copies)
    out = round_rates(rated, "_key", max_copies)
    return out.select(
        id_col, "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *keep
    )


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
