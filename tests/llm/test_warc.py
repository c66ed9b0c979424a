import gzip
import hashlib
import io
import random
from collections import defaultdict

import pytest

from multitopic.llm import warc as W
from multitopic.session import scratch_path


def pages():
    rng = random.Random(7)
    texts = [None, "", "short", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "é" * 700, "x" * 999, "y" * 1000, "big" * 200_000]
    texts += ["".join(rng.choice("abc\r\n") for _ in range(rng.randrange(3000))) for _ in range(20)]
    rows = [(k, f"http://h/{k}%\r\nx" if k % 3 else None, t) for k, t in enumerate(texts)]
    rows += [(100 + k, "u", rng.choice([t for t in texts if t and len(t) >= 700])) for k in range(40)]
    return rows + [(500, "u", "y" * 1000), (500, "u", "y" * 1000), (None, "u", "y" * 1000), (None, None, "nobody" * 300)]


def brute(rows):
    largest = defaultdict(lambda: None)
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None:
            largest[b] = max(i, largest[b] if largest[b] is not None else i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        again = len(b) >= 1000 and largest[b] is not None and i != largest[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' AS digest", "1 AS size", "'p' AS payload").repartition(3)
    got = sorted((tuple(r) for r in W.archive_pages(df).collect()), key=str)
    assert got == brute(rows)


def test_small_archives_members_and_sidecar(spark):
    folder = scratch_path(spark, "warc-test")
    records = W.records_of(spark.createDataFrame(pages(), "page_id bigint, url string, html string"))
    archives = W.write_archives(records, f"{folder}/a", archive_bytes=20_000)
    assert archives.count() > 3
    members = W.normalise(archives, f"{folder}/b")
    index = W.read_index(spark, f"{folder}/b", members).collect()
    assert len(index) == len(pages()) == sum(r.records for r in members.collect())
    for r in index:
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            headers, block = W.parse_record(gzip.decompress(f.read(r.length)))
        assert headers["warc-record-id"] == r.record_id and headers["warc-type"] == r.type
    whole = b"".join(gzip.open(r.archive.removeprefix("file:")).read() for r in members.collect())
    assert sum(1 for _ in W.split_records(iter([whole]))) == len(pages())


def test_inflate_pieces_members_and_damage():
    data = bytes(range(256)) * 50_000
    assert b"".join(W.inflate(io.BytesIO(gzip.compress(data)))) == data
    assert b"".join(W.inflate(io.BytesIO(gzip.compress(b"a") + gzip.compress(b"") + gzip.compress(data)))) == b"a" + data
    with pytest.raises(ValueError):
        list(W.inflate(io.BytesIO(gzip.compress(data)[:-20])))
    with pytest.raises(ValueError):
        list(W.split_records(iter([W.record_bytes(1, "u", b"abc", "00" * 20, 3, None)[:-6]])))


def test_empty_table(spark):
    assert W.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
