import random

import pyarrow as pa

from multitopic.llm import cdc_dedup as C
from multitopic.llm.text import slices

from . import messy


def chunked(text: str) -> list[bytes]:
    got = []
    for s in slices(pa.array([text])):
        last = 0
        for e in C.cuts(s)[0].tolist():
            got.append(bytes(s.data[last:e]))
            last = e
    return got


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(9)
    text = " ".join(messy.sentence(rng, 3000)) + "é" * 5000
    a = chunked(text)
    assert b"".join(a).decode() == text and all(x.decode() for x in a)
    assert max(map(len, a)) <= C.MAX_CHUNK + 3 and min(map(len, a[:-1])) >= C.MIN_CHUNK
    b = chunked(text[:700] + "inserted" + text[700:])
    assert len(set(a) - set(b)) <= 4
    (s,) = slices(pa.array(["padding here", text]))  # cuts do not depend on the text before
    assert [int(x) for x in C.cuts(s)[1] - s.offs[1]] == [len(b"".join(a[: k + 1])) for k in range(len(a))]


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(10)
    passage = " ".join(messy.sentence(rng, 55))
    clean = [(k, " ".join(messy.sentence(rng, 150))) for k in range(80)]
    planted = [(100 + k, " ".join([*messy.sentence(rng, 40), passage, *messy.sentence(rng, 40)])) for k in range(80)]
    odd = [(300, None), (301, ""), (302, "short"), (303, "short"), (None, clean[5][1]), (304, clean[6][1]), (304, clean[6][1]), (305, " ".join(messy.sentence(rng, 20000)))]
    rows = clean + planted + odd
    texts = {i: (t or "").encode() for i, t in rows}
    df = messy.frame(spark, rows)
    spans = C.repeated_spans(df).collect()
    for r in spans:
        a = texts[r.doc_id][r.start_byte : r.end_byte]
        assert len(a) >= C.MIN_SPAN and a == texts[r.first_id][r.first_byte : r.first_byte + len(a)]
        assert (r.first_id is not None, r.first_id or 0, r.first_byte) < (r.doc_id is not None, r.doc_id or 0, r.start_byte)
    assert {r.doc_id for r in spans} == {*range(101, 180), 5, 304}
    left = {r.doc_id: r.text for r in C.cut_repeats(df).collect() if r.doc_id is not None}
    assert sum(passage[40:200] in (t or "") for t in left.values()) == 1
    assert all(left[i] == t for i, t in clean if i != 5) and C.cut_repeats(df).columns == df.columns


def test_empty_table(spark):
    assert C.repeated_spans(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_repeats_do_not_depend_on_unrelated_texts(spark):
    rng = random.Random(21)
    passage = " ".join(messy.sentence(rng, 55))
    inner = chunked("x " * 20 + passage)
    # every other chunk of the passage also stands in an earlier unrelated text
    stray = [(k, " ".join(messy.sentence(rng, 30)) + inner[k].decode() + " ".join(messy.sentence(rng, 30))) for k in range(2, len(inner) - 1, 2)]
    chain = [" ".join(messy.sentence(rng, 400))]
    for k in range(1, 30):  # each copy edits the one before
        copy = chain[-1].split()
        copy[rng.randrange(len(copy))] = f"e{k}"
        chain.append(" ".join(copy))
    rows = stray + [(100, "x " * 20 + passage), (101, "y " * 30 + passage)] + [(200 + k, t) for k, t in enumerate(chain)]
    df = messy.frame(spark, rows)
    texts = {i: t.encode() for i, t in rows}
    covered = {i: set() for i in texts}
    for r in C.repeated_spans(df).collect():
        a = texts[r.doc_id][r.start_byte : r.end_byte]
        assert len(a) >= C.MIN_SPAN and a == texts[r.first_id][r.first_byte : r.first_byte + len(a)]
        assert abs(r.n_words - len(a.split())) <= 1
        covered[r.doc_id].update(range(r.start_byte, r.end_byte))
    seen: set[bytes] = set()
    for i, t in rows:  # brute force: all runs of chunks that are long enough
        ends = [0]
        for c in chunked(t):
            ends.append(ends[-1] + len(c))
        runs = [(a, b) for k, a in enumerate(ends) for b in ends[k + 1 : k + 12] if b - a >= C.MIN_SPAN]
        assert covered[i] == {x for a, b in runs if texts[i][a:b] in seen for x in range(a, b)}
        seen.update(texts[i][a:b] for a, b in runs)
    begin = texts[101].index(passage.encode())
    assert set(range(begin + 60, begin + len(passage) - 60)) <= covered[101]
    left = {r.doc_id: (r.text or "").encode() for r in C.cut_repeats(df).collect()}
    assert all(left[i] == bytes(x for k, x in enumerate(t) if k not in covered[i]) for i, t in texts.items())


def test_rows_are_told_apart(spark):
    """Null ids, shared ids with different texts, and equal rows."""
    rng = random.Random(31)
    text = " ".join(messy.sentence(rng, 60))
    other = " ".join(messy.sentence(rng, 60))
    rows = [(None, text)] * 5 + [(2, "é" * 400), (2, text), (2, "short"), (3, other), (3, other), (3, other), (4, "x " + other)]
    df = messy.frame(spark, rows)
    size = len(text.encode())
    got = [(r.doc_id, r.start_byte, r.end_byte) for r in C.repeated_spans(df).collect()]
    assert sum(i is None and (a, e) == (0, size) for i, a, e in got) == 4
    assert got.count((2, 0, size)) == 1 and got.count((3, 0, len(other.encode()))) == 2
    assert any(i == 4 for i, _, _ in got)
    left = sorted((str(r.doc_id), r.text) for r in C.cut_repeats(df).collect())
    assert [t for i, t in left if i == "None"].count(text) == 1 and [t for i, t in left if i == "None"].count("") == 4
    shared = [t for i, t in left if i == "2"]
    assert "short" in shared and "" in shared and max(map(len, shared)) > 0
    assert len(left) == len(rows) and [t for i, t in left if i == "3"].count(other) == 1
    accents = next(t for t in shared if t and t.startswith("é"))
    assert set(accents) == {"é"}


def test_windows_carry_a_text_hash_only_where_ids_are_shared(spark):
    """An id of one row tells its text: no hash, which would not compress, in
    each of its windows; the spans are the same as with hashes everywhere."""
    rng = random.Random(47)
    passage = " ".join(messy.sentence(rng, 55))
    rows = [(k, " ".join([*messy.sentence(rng, 40), passage])) for k in range(20)]
    rows += [(5, "other " + passage), (None, "one " + passage), (None, "two " + passage), (21, rows[3][1]), (22, rows[4][1]), (22, rows[4][1])]
    df = messy.frame(spark, rows)
    shared = C.shared_ids(df, "doc_id")
    marks = {(r.id, r.h) for r in C.window_rows(df, "text", "doc_id", C.MIN_SPAN, shared).select("id", "h").distinct().collect()}
    assert {i for i, h in marks if h} == {5, 22, None} and {i for i, h in marks if not h} == {*range(22)} - {5, 20}
    assert len([1 for i, h in marks if i in (5, None)]) == 4
    columns = ["id", "later", "rows", "start_byte", "end_byte", "n_words", "first.id", "first_byte"]
    assert C.repeated_spans(df).count() > 20
    plain = [(r[0], *r[3:]) for r in C._spans(df, "text", "doc_id", C.MIN_SPAN).selectExpr(*columns, "explode(sequence(1, rows))").drop("col").collect()]
    assert sorted(map(str, plain)) == sorted(str(tuple(r)) for r in C.repeated_spans(df).collect())
