"""Multi-type corpora as long DataFrames.

A corpus is ``(doc_id BIGINT, type_id INT, term STRING, cnt DOUBLE)``:
one row per (document, type, term), duplicate-free, ``cnt > 0``. The
documents of all types are matched by ``doc_id`` (the reference matches
them by position). A document missing a type simply has no rows there.

Builders here turn ordinary tables into such corpora (S1, S2, J1, P11),
and derive the vocabulary (S3, S4, U5), document order and chunks (S6),
corpus sizes (S5), document lengths (A8) and term frequencies (A9, P12).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: token pattern, letters only (text -> bag of words).
TOKEN_SPLIT = r"[^\p{L}]+"

CORPUS_COLS = ["doc_id", "type_id", "term", "cnt"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ builders
def corpus_from_table(
    df: DataFrame, doc: str | Column, term: str | Column, type_id: int | str | Column = 0, weight: str | Column | None = None
) -> DataFrame:
    """Any table -> long corpus rows; duplicate (doc, type, term)
    rows are summed (partial aggregation before the shuffle)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    tcol = F.lit(type_id) if isinstance(type_id, int) else c(type_id)
    wcol = F.lit(1.0) if weight is None else c(weight)
    out = df.select(
        c(doc).cast("bigint").alias("doc_id"),
        tcol.cast("int").alias("type_id"),
        c(term).cast("string").alias("term"),
        wcol.cast("double").alias("cnt"),
    ).where(F.col("term").isNotNull() & F.col("doc_id").isNotNull())
    return (
        out.groupBy("doc_id", "type_id", "term")
        .agg(F.sum("cnt").alias("cnt"))
        .where(F.col("cnt") > 0)
    )


def union_types(*parts: DataFrame) -> DataFrame:
    """The positional zip of T corpora becomes a union keyed by doc_id."""
    out = parts[0].select(*CORPUS_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*CORPUS_COLS))
    return out


SPREAD_BYTES = 1 << 30
#: line items per task of the join with the orders
JOIN_ROWS = 250_000
#: bytes of the terms that :func:`encode` broadcasts at most
FREQUENT_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    """Lower-cased letter runs; empty strings removed."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: F.length(w) > 0)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small scan with fewer partitions than task slots (such as
    one Parquet row group, which one task reads) over all slots before heavy
    per-row work. Above ``SPREAD_BYTES`` by Catalyst's estimate the input is
    left alone, however many slots there are: raw text is never shuffled at
    scale (write row groups of a split's size, or lower
    ``spark.sql.files.maxPartitionBytes``, for more tasks)."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(slots) if estimate <= SPREAD_BYTES and df.rdd.getNumPartitions() < slots else df


def corpus_from_text(df: DataFrame, doc: str, text: str, type_id: int | str | Column = 0) -> DataFrame:
    """S2 doc2bow over whole texts: explode tokens, count per term."""
    c = F.lit(type_id) if isinstance(type_id, int) else (F.col(type_id) if isinstance(type_id, str) else type_id)
    words = spread(df).select(
        F.col(doc).cast("bigint").alias("doc_id"), c.cast("int").alias("type_id"), F.explode(tokens(F.col(text))).alias("term")
    )
    return words.groupBy("doc_id", "type_id", "term").agg(F.count("*").cast("double").alias("cnt"))


# ------------------------------------------------------------ named corpora
PURCHASE_TYPES = ["product", "supplier_nation", "event"]
CONVERSATION_ROLES = ["system", "user", "assistant"]
TEXT_TYPES = ["word", "source", "lang"]


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer documents with three term types: purchased product class
    weighted by quantity, supplier nation (count) and web event type (count)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("product"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    ev = table(spark, sf_dir, "events").select("user_id", "event_type")
    # one pass over lineitem: each line item yields its product term and its
    # supplier-nation term; (left joins: a missing part or supplier drops only
    # that term, as two separate inner joins would)
    named = (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(sn, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .select("l_orderkey", "l_quantity", "product", "n_name")
    )
    # bounded numbers of line items: the last join's sorts and the partial sums
    # behind it share a task, and AQE cuts tasks by shuffled bytes alone
    n = -(-li.count() // JOIN_ROWS)
    if n > spark.sparkContext.defaultParallelism:
        named, o = named.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    lo = named.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    items = lo.select(
        F.col("o_custkey").alias("doc"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("t"), F.col("product").alias("w"), F.col("l_quantity").alias("c")),
                F.struct(F.lit(1).alias("t"), F.col("n_name").alias("w"), F.lit(1.0).alias("c")),
            )
        ).alias("x"),
    )
    lines = corpus_from_table(items, "doc", F.col("x.w"), F.col("x.t"), F.col("x.c"))
    return union_types(lines, corpus_from_table(ev, "user_id", "event_type", 2))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation documents, one term type per speaker role."""
    cv = table(spark, sf_dir, "conversations").select("conv_id", "role", "text")
    role_id = (
        F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
    )
    return corpus_from_text(cv.withColumn("type_id", role_id).where(F.col("type_id").isNotNull()), "conv_id", "text", "type_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents table: words of the whole text, the source and the language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return union_types(
        corpus_from_text(d, "doc_id", "text", 0),
        corpus_from_table(d, "doc_id", "source", 1),
        corpus_from_table(d, "doc_id", "lang", 2),
    )


def user_days(events: DataFrame) -> DataFrame:
    """User-day documents from events: event types and value buckets.
    doc_id = user_id * 100000 + days since 1970-01-01."""
    day = F.datediff(F.to_date(F.col("ts")), F.lit("1970-01-01").cast("date"))
    doc = F.col("user_id") * F.lit(100000) + day
    bucket = F.concat(F.lit("v"), F.floor(F.col("value") / 100).cast("bigint").cast("string"))
    return union_types(
        corpus_from_table(events, doc, "event_type", 0),
        corpus_from_table(events.where(F.col("value").isNotNull()), doc, bucket, 1),
    )


# --------------------------------------------------------------- dense ids
def dense_index(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row in ``order`` without a
    single-partition window: range-partition + sort, number rows inside
    each partition, add per-partition offsets (one small table, broadcast).
    The numbered table is checkpointed so both passes see the same rows."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    ).checkpoint(eager=True)
    counts = x.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")
    )
    return x.join(F.broadcast(offs), "_pid").withColumn(name, (F.col("_off") + F.col("_row")).cast("bigint")).drop(
        "_pid", "_row", "_off"
    )


# -------------------------------------------------------------- vocabulary
def vocabulary(corpus: DataFrame) -> DataFrame:
    """S3: ``(type_id, term_id, term, doc_freq, coll_freq)``; ``term_id`` is the
    0-based rank of the term inside its type in byte order."""
    stats = corpus.groupBy("type_id", "term").agg(
        F.count("*").alias("doc_freq"), F.sum("cnt").alias("coll_freq")
    )
    idx = dense_index(stats, ["type_id", "term"], "_g")
    starts = idx.groupBy("type_id").agg(F.min("_g").alias("_start"))
    return (
        idx.join(F.broadcast(starts), "type_id")
        .select(
            "type_id",
            (F.col("_g") - F.col("_start")).cast("int").alias("term_id"),
            "term",
            F.col("doc_freq").cast("bigint").alias("doc_freq"),
            F.col("coll_freq").cast("double").alias("coll_freq"),
        )
    )


def num_terms(vocab: DataFrame, num_types: int | None = None) -> list[int]:
    """Terms per type (driver-sized list); empty type -> error."""
    rows = vocab.groupBy("type_id").agg(F.count("*").alias("n")).collect()
    got = {r["type_id"]: r["n"] for r in rows}
    t = num_types if num_types is not None else (max(got) + 1 if got else 0)
    sizes = [int(got.get(i, 0)) for i in range(t)]
    if not sizes or any(s == 0 for s in sizes):
        raise ValueError("every type needs at least one term in the vocabulary")
    return sizes


def encode(corpus: DataFrame, vocab: DataFrame, strict: bool = True) -> DataFrame:
    """Terms -> ids. Out-of-vocabulary rows raise (``strict``) or are
    dropped (scoring). Joined on (type_id, term): the most frequent terms, up to
    ``FREQUENT_BYTES``, are met in place from a broadcast, so that most of a
    corpus is not shuffled for its ids and no frequent term crowds a reducer;
    rows of the others are shuffled unless Catalyst broadcasts the vocabulary.
    One frequent term alone above that size leaves terms in more documents than
    one reducer's share split off (:mod:`..operators.skew`)."""
    from ..operators.skew import frequent_keys, hot_keys, split_join

    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.lit(24) + F.octet_length("term")
    hot = frequent_keys(vocab, ["type_id", "term"], row, FREQUENT_BYTES)
    if hot is None:
        hot = hot_keys(vocab, ["type_id", "term"], n)
    enc = split_join(corpus, vocab.select("type_id", "term", "term_id"), ["type_id", "term"], hot, row, 64 << 20)
    if strict:
        oov = corpus.join(vocab.select("type_id", "term"), ["type_id", "term"], "left_anti").limit(1).count()
        if oov:
            raise ValueError("corpus has terms outside the vocabulary")
    return enc.select("doc_id", "type_id", "term_id", "cnt")


def oov_report(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows of a corpus whose term is unknown to the vocabulary."""
    return corpus.join(vocab.select("type_id", "term"), ["type_id", "term"], "left_anti")


# ----------------------------------------------------------------- sizes
def corpus_size(corpus: DataFrame) -> DataFrame:
    """Documents and tokens, overall and per type."""
    return corpus.groupBy("type_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.sum("cnt").alias("n_tokens")
    )


def doc_lengths(corpus: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Per document the sum of counts over terms and types; documents of
    ``docs`` without rows get 0."""
    lens = corpus.groupBy("doc_id").agg(F.sum("cnt").alias("doc_length"))
    if docs is None:
        return lens
    return docs.select("doc_id").join(lens, "doc_id", "left").select("doc_id", F.coalesce("doc_length", F.lit(0.0)).alias("doc_length"))


def term_frequency(corpus: DataFrame, vocab: DataFrame, beta: float = 0.01) -> DataFrame:
    """Collection frequency per term; a zero frequency becomes ``beta``."""
    tf = corpus.groupBy("type_id", "term").agg(F.sum("cnt").alias("f"))
    return vocab.select("type_id", "term_id", "term").join(tf, ["type_id", "term"], "left").select(
        "type_id", "term_id", "term", F.when(F.coalesce("f", F.lit(0.0)) == 0, F.lit(beta)).otherwise(F.col("f")).alias("term_frequency")
    )


def chunk_assignment(doc_ids: DataFrame, chunksize: int) -> DataFrame:
    """Documents in doc_id order, cut into chunks of ``chunksize`` (last
    chunk short): ``(doc_id, doc_index, chunk_id)``."""
    d = dense_index(doc_ids.select("doc_id").distinct(), ["doc_id"], "doc_index")
    return d.withColumn("chunk_id", F.floor(F.col("doc_index") / F.lit(chunksize)).cast("bigint"))


# MLlib vector fields as Spark stores them (sparse: type 0, dense: type 1)
VECTOR_FIELDS = "type TINYINT, size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>"


def corpus_from_vectors(df: DataFrame, doc: str, vec: str, type_id: int = 0) -> DataFrame:
    """An ``ml.linalg`` vector column (sparse or dense) -> long rows with
    integer term ids (``term`` = the id as text). The vector's stored fields
    are read JVM-side, so a sparse vector is never densified: work and
    output grow with its non-zeros, not with its dimension."""
    fields = F.from_json(F.to_json(F.struct(F.col(vec).alias("v"))), f"v STRUCT<{VECTOR_FIELDS}>").getField("v")
    x = df.select(F.col(doc).cast("bigint").alias("doc_id"), fields.alias("_v"))
    pairs = F.transform(
        F.col("_v.values"),
        lambda c, j: F.struct(
            F.when(F.col("_v.type") == 0, F.col("_v.indices")[j]).otherwise(j).alias("i"), c.alias("c")
        ),
    )
    ex = x.select("doc_id", F.explode(pairs).alias("_e")).where(F.col("_e.c") != 0)
    return ex.select(
        "doc_id",
        F.lit(type_id).cast("int").alias("type_id"),
        F.col("_e.i").cast("string").alias("term"),
        F.col("_e.c").cast("double").alias("cnt"),
    )


def to_vectors(entries: DataFrame, vocab: DataFrame, type_id: int, path: str) -> DataFrame:
    """S7 sink: the terms of one type as an MLlib sparse count vector per
    document (size = the type's vocabulary), written as Parquet to ``path``
    and read back as a ``vector`` column. One row per document, so a group
    holds at most that document's distinct terms."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    size = num_terms(vocab)[type_id]
    per_doc = (
        entries.where(F.col("type_id") == type_id)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("term_id", "cnt"))).alias("_x"))
    )
    stored = per_doc.select(
        "doc_id",
        F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(size).cast("int").alias("size"),
            F.transform("_x", lambda e: e["term_id"]).alias("indices"),
            F.transform("_x", lambda e: e["cnt"]).alias("values"),
        ).alias("vec"),
    )
    stored.write.mode("overwrite").parquet(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("vec", VectorUDT())])
    return entries.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Corpus:
    """An encoded corpus: ``entries(doc_id, type_id, term_id, cnt)`` plus the
    vocabulary it was encoded with and the number of types."""

    entries: DataFrame
    vocab: DataFrame
    num_types: int

    @staticmethod
    def build(terms: DataFrame, vocab: DataFrame | None = None, num_types: int | None = None, strict: bool = True) -> "Corpus":
        """Encode ``terms``; they are read by several jobs, so terms, vocabulary
        and entries are written to the checkpoint folder once each."""
        from ..session import materialize

        terms = materialize(terms, "terms")
        if vocab is None:
            vocab, strict = materialize(vocabulary(terms), "vocab"), False  # of these very terms: nothing to check
        if num_types is None:
            num_types = len(num_terms(vocab))
        return Corpus(materialize(encode(terms, vocab, strict), "entries"), vocab, num_types)
