from multitopic.llm import license_scan as L

from . import messy

TEXTS = [
    "All Rights Reserved. cc by, CC-BY 4.0 general\npublic license", "cc by cc by cc by", "allrights reserved", "ALL  rights -- RESERVED",
    "Licensed under the new Apache License, Version 2.0", "Released under the very MIT License", "released under the license",
    "Permission is hereby granted, free of charge, to any person or company obtaining a copy of this software and associated documentation files",
    "cc K by", "general publiK license", "cc byé", None, "", "word", "licensed under cc by nc 4 0",
]


def test_places_match_brute_force(spark):
    rows = messy.documents() + [(20_000 + k, t) for k, t in enumerate(TEXTS)]
    rows.append((30_000, " ".join((rows[k][1] or "") + " all rights reserved cc by" for k in range(60))))
    got = {r.doc_id: r for r in L.license_scan(messy.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        w, r = messy.alnum_words(t), got[i]
        found = [(k, label) for phrase, label in L.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in found]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_gapped_notices(spark):
    got = {r.doc_id: r.labels for r in L.license_scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")).collect()}
    assert got[4] == "apache-2.0" and got[5] == "mit" and got[6] == "" and got[7] == "mit"
    assert got[14] == "cc-by,cc-by-nc"


def test_empty_null_and_repeats(spark):
    """Every row by its own text: shared and null ids mix nothing, equal rows stay."""
    schema = "doc_id bigint, text string"
    assert L.license_scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "cc by"), (1, "cc by"), (1, "cc by"), (2, None), (2, ""), (7, "all rights x"), (7, "y rights reserved"), (None, "all rights x"), (None, "y rights reserved"), (None, "cc by")]
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.labels, r.score) for r in L.license_scan(spark.createDataFrame(rows, schema)).collect())
    by = [(2, 1, "cc-by", 1.0)] * 2
    assert got == sorted([("1", *x) for x in by] + [("None", *x) for x in by] + [("2", 0, 0, "", 0.0)] * 2 + [(i, 3, 0, "", 0.0) for i in ("7", "7", "None", "None")])


def test_spans_are_verified(spark):
    """Words of a notice strewn over a text, or in another order, are no notice."""
    texts = [
        "licensed under foo under the bar the apache baz apache license qux license version quux version 2",
        "version 2 license version apache license the apache under the licensed under",
        "x licensed under the apache license version 2 0 y",
        "licensed under the one apache license two version 2 0",
        "licensed under the apache license version 2 0 and once more licensed under the apache license version 2 0",
    ]
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got[0] == ("", 0.0) and got[1] == ("", 0.0)
    assert got[2] == ("apache-2.0", 1.0) and got[4] == ("apache-2.0", 1.0)
    assert got[3][0] == ("apache-2.0" if got[3][1] >= L.SHARE else "")


def test_no_python_in_the_plan(spark):
    plan = L.license_scan(messy.frame(spark, messy.documents()[:3]).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
