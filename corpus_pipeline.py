"""Training-corpus pipeline: toxicity, exact dedup, n-gram Jaccard join,
benchmark decontamination, mixing sources to target weights.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but
the last return the columns of ``docs``; the last adds ``copies`` (how often
a document enters the mix; documents with none are left out). ``run`` writes
every stage's rows as Parquet to the shared checkpoint folder and reads them
back as the next stage's ``docs``.

The n-gram join decides on ids, as its operator does: rows that share an id are
kept or dropped together, rows without an id are kept. The source mix decides
on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from multitopic.llm import decontam, entropy_mix, exact_dedup, ngram_join, toxicity_fm
from multitopic.session import ensure_checkpoint_dir, materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_fm.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each linked group the document with the smallest id stays."""
    classes = ngram_join.link_components(docs)
    gone = classes.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; mostly contaminated documents go."""
    clean = decontam.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets the copies dealt to it, with or without an id of its own:
    rows are met by id, text and source, rows equal in these one by one."""
    key, number = "_row_key", "_row_number"
    while key in docs.columns or number in docs.columns:
        key, number = key + "_", number + "_"
    docs = docs.drop("copies").withColumn(key, F.md5(F.to_json(F.struct("doc_id", "text", "source"))))
    numbered = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    mixed = entropy_mix.mix_sources(docs, keep=(key,)).select(key, "copies").withColumn(number, numbered)
    return docs.withColumn(number, numbered).join(mixed, [key, number]).where("copies > 0").drop(key, number)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("source_mix", source_mix),
]

#: the learned and rounded stages have no SQL form; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
