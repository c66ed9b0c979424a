"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

``write_archives``: every task writes its records to archives that are one
whole gzip stream (as crawlers that compress the finished file leave them).
``normalise``: every task inflates such a file once, front to back, in small
pieces, rewrites each record as a gzip member of its own and writes a sidecar
index (tab-separated: archive, offset, length, record id, type) beside it.
``read_records``: the sidecar rows are read with Spark, dealt by archive and
block, and each record is fetched by its offset.

Archives have names of their own per task attempt; a DataFrame of the names
that committed tasks returned decides which sidecar rows count, so retried or
speculative tasks leave no double records. All files are below the shared
folder ``spark.checkpoint.dir``; Python workers reach it through
``pyarrow.fs`` (local, HDFS, S3, GCS paths).

Defined results: a null html is the empty payload; a null url is empty, line
breaks in it are percent-encoded; rows that share page id and payload are
alike (the ones with the largest id are all responses); a null page id never
is the largest and is read back as null; an empty table gives an empty
result; further columns are ignored. Memory is bounded by the largest record.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = "archive string, offset bigint, length bigint, record_id string, type string"


def open_path(path: str):
    """``(filesystem, path)`` of a URI or a plain local path."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    uri = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("record without a WARC version line")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def inflate(stream) -> Iterator[bytes]:
    """Inflated pieces of a gzip file, of however many members."""
    z = zlib.decompressobj(31)
    while piece := stream.read(PIECE):
        while piece:
            if z.eof:
                z = zlib.decompressobj(31)
            out = z.decompress(piece, 4 * PIECE)
            piece = z.unconsumed_tail or z.unused_data
            if out:
                yield out
    if not z.eof:
        tail = z.flush()
        if tail:
            yield tail
        if not z.eof:
            raise ValueError("truncated gzip stream")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated pieces."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                for line in bytes(held[:at]).split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length":
                        need = at + 4 + int(value) + 4
                if need is None:
                    raise ValueError("record without Content-Length")
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("bytes after the last whole record")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``(page_id, url, payload, digest, size, refers_to)`` rows to
    monolithic archives; returns ``(path, records)`` of the finished ones."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(folder)
        out, z, path, count, size = None, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

        for b in batches:
            get = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "digest", "size", "refers_to")]
            for i in range(b.num_rows):
                if out is None:
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    path, count, size = f"{folder}/{name}", 0, 0
                    out, z = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record_bytes(*(c[i].as_py() for c in get))
                out.write(z.compress(data))
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    _make_folder(records.sparkSession, folder)
    return materialize(records.mapInArrow(write, "path string, records bigint"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite the archives named in ``path`` record by record into ``folder``;
    returns ``(archive, records)`` of the finished ones."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                src_fs, src = open_path(path)
                name = f"member-{uuid.uuid4().hex}.warc.gz"
                at = count = 0
                with src_fs.open_input_stream(src, compression=None) as stream, fs.open_output_stream(f"{base}/{name}", compression=None) as out, fs.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for data in split_records(inflate(stream)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        headers, _ = parse_record(data)
                        index.write(f"{folder}/{name}\t{at}\t{len(member)}\t{headers['warc-record-id']}\t{headers['warc-type']}\n".encode())
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

    _make_folder(archives.sparkSession, folder)
    paths = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return materialize(paths.mapInArrow(rewrite, "archive string, records bigint"), "members")


def read_index(spark: SparkSession, folder: str, members: DataFrame) -> DataFrame:
    """Sidecar rows of the archives that finished tasks named."""
    if members.isEmpty():
        return spark.createDataFrame([], INDEX_SCHEMA)
    rows = spark.read.schema(INDEX_SCHEMA).option("sep", "\t").option("quote", "").csv(f"{folder}/*.idx")
    return rows.join(members.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``;
    a response's digest is taken from its payload and held against the header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held, handle = None, None
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != held:
                    if handle is not None:
                        handle.close()
                    fs, path = open_path(archive)
                    held, handle = archive, fs.open_input_file(path)
                handle.seek(offset)
                headers, block = parse_record(zlib.decompress(handle.read(length), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = headers["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                number = lambda x: int(x) if (x := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None
                for k, v in zip(rows, (number(headers["warc-record-id"]), size, digest, kind, number(headers.get("warc-refers-to"))), strict=True):
                    rows[k].append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))
        if handle is not None:
            handle.close()

    block = F.floor(F.col("offset") / F.lit(ARCHIVE_BYTES // 8))
    parts = max(1, index.sparkSession.sparkContext.defaultParallelism * 4)
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive", block).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _make_folder(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def records_of(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rows for ``write_archives``. Revisits are decided on ids and digests
    alone; the html is joined by page id and digest, so equal pages spread out."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    full = full.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    thin = materialize(full.where(F.col("size") >= min_revisit).select("page_id", "digest", "size"), "payloads")
    keep = thin.groupBy("digest", "size").agg(F.max("page_id").alias("keep")).where("keep IS NOT NULL")
    again = thin.join(keep, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("keep"))).select(F.coalesce("page_id", F.lit(-1)).alias("_k"), F.col("page_id").isNull().alias("_none"), F.col("digest").alias("_d"), F.col("keep").alias("refers_to")).distinct()
    on = (F.coalesce("page_id", F.lit(-1)) == F.col("_k")) & (F.col("page_id").isNull() == F.col("_none")) & (F.col("digest") == F.col("_d"))
    marked = full.join(again, on, "left").drop("_k", "_none", "_d")
    return marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def archive_pages(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write, normalise and read back; returns the records read."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archives = write_archives(records_of(pages, min_revisit), f"{folder}/monolithic")
    members = normalise(archives, f"{folder}/members")
    return read_records(read_index(spark, f"{folder}/members", members))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS k FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> k THEN k END AS refers_to
FROM s
"""
