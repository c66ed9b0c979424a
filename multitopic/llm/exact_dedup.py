"""Exact dedup with a heavy-hitter split (DataFrame functions only).

1. A frequent-items sketch (``approx_top_k``, a mergeable Misra-Gries summary
   of bounded size) names at most ``top`` candidate digests.
2. Their exact counts and largest ids are aggregated; those holding at least
   ``min_share`` of the rows are the winners.
3. The winners (at most ``top`` rows, so the broadcast is bounded) are joined
   map-side: rows of a heavy group never travel.
4. All other digests meet in an ordinary shuffle; no group there exceeds
   about ``min_share`` of the rows.

Defined results: a null text is the empty text; equal texts are one group
whichever their other columns; a null id ranks below all others; of rows that
repeat the largest id with the same text exactly one is kept; an empty table
gives an empty result; further columns pass through unread (in
``mark_duplicates`` the columns ``keep_id group_size kept`` replace columns of
these names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

TOP = 1000
TRACKED = 16_384


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def heavy_digests(rows: DataFrame, id_col: str, top: int = TOP, tracked: int = TRACKED, min_share: float = 1e-3) -> DataFrame:
    """``(text_sha256, _n, _keep)`` of the verified heavy groups, at most ``top`` rows."""
    found = rows.agg(F.expr(f"approx_top_k(text_sha256, {int(top)}, {int(tracked)})").alias("_top"), F.count("*").alias("_rows"))
    cand = found.select("_rows", F.explode("_top").alias("_c")).select(F.col("_c.item").alias("text_sha256"), "_rows")
    exact = rows.join(F.broadcast(cand), "text_sha256").groupBy("text_sha256").agg(
        F.count("*").alias("_n"), F.max(id_col).alias("_keep"), F.max("_rows").alias("_rows")
    )
    return exact.where((F.col("_n") >= 2) & (F.col("_n") >= F.col("_rows") * F.lit(float(min_share)))).select("text_sha256", "_n", "_keep")


def mark_duplicates(rows: DataFrame, id_col: str = "doc_id", top: int = TOP, tracked: int = TRACKED, min_share: float = 1e-3) -> DataFrame:
    """``rows`` (with ``text_sha256``) plus ``keep_id``, ``group_size``, ``kept``."""
    rows = rows.drop("keep_id", "group_size", "kept")
    heavy = F.broadcast(materialize(heavy_digests(rows.select(id_col, "text_sha256"), id_col, top, tracked, min_share), "heavy"))
    split = rows.join(heavy, "text_sha256", "left")
    hot = split.where(F.col("_n").isNotNull())
    first = Window.partitionBy("text_sha256").orderBy(F.lit(1))
    is_keeper = F.col(id_col).eqNullSafe(F.col("_keep"))
    dropped = hot.where(~is_keeper).withColumn("kept", F.lit(False))
    keepers = hot.where(is_keeper).withColumn("kept", F.row_number().over(first) == 1)
    light = rows.join(heavy, "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    order = group.orderBy(F.col(id_col).desc_nulls_last())
    light = light.select(
        "*", F.count("*").over(group).alias("_n"), F.max(id_col).over(group).alias("_keep"), (F.row_number().over(order) == 1).alias("kept")
    )
    out = dropped.unionByName(keepers).unionByName(light)
    return out.withColumnsRenamed({"_n": "group_size", "_keep": "keep_id"})


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Only
    ids and digests are written and shuffled, texts are read once."""
    rows = materialize(with_digest(docs, text).select(id_col, "text_sha256"), "digests")
    return mark_duplicates(rows, id_col, **kw).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def keep_first_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """The kept rows of ``docs`` with their own columns, whatever their names."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    return mark_duplicates(with_digest(rows, "_text").drop("_text"), "_id", **kw).where("kept").select("_row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
