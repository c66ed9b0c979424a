"""Session helpers: a local session for tests/bench and the shared
checkpoint folder used to cut lineage between model versions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "multitopic") -> SparkSession:
    """Session for tests and the local benchmark (never used by the library
    itself: the library always takes the caller's session)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names a shared file system; it is only read, and
    must be there: a folder of the driver's own would be another folder on
    every executor. Only on a local master a scratch folder is created."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="multitopic-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory name below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/multitopic/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it
    back: cuts lineage and survives executor loss (unlike a local
    checkpoint)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote below the checkpoint folder (an
    intermediate or superseded model version)."""
    if "/multitopic/" not in path:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists; a storage error is raised, not taken for absence."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in place with one rename, so a reader
    sees the old text or the new one."""
    jvm = spark.sparkContext._jvm
    fs, tmp = _fs_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(tmp.getParent())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The text of a pointer file, None only where there is no such file."""
    if not path_exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def source_path(df: DataFrame) -> str | None:
    """The folder a materialised DataFrame was read from (None otherwise)."""
    files = df.inputFiles()
    if not files:
        return None
    return files[0].rsplit("/", 1)[0]
