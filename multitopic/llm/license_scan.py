"""License scan by diagonal voting (DataFrame functions only).

Every text's rolling 2-word hashes are joined with the 2-word hashes of the
notice templates (a fixed broadcast table of a few hundred rows). A match at
text word ``p`` and template word ``t`` votes for diagonal ``p - t``, where
the notice would start. Votes are aggregated per (text, template,
diagonal); diagonals that lie within ``GAP`` words of each other are merged
(inserted or missing words shift the rest of a notice to a neighbouring
diagonal). A merged span is then verified: of its diagonals only those within
``GAP`` of the one with most votes count, so at most that many words are
inserted or missing before any place; each of the template's 2-grams stands where the nearest of
these diagonals has it, and counts if it stands behind all earlier ones. The
span stands when the 2-grams that count reach the template's share. A base
phrase needs all of its 2-grams on one diagonal, that is, its words
consecutively.

Words are maximal runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased.
Word equality is equality of 64-bit hashes.

Defined results: null or wordless texts have n_words 0, no labels, score 0;
every row gives a row, decided by its own text, whatever ids are shared or null
(rows equal in id and text are worked off once and returned as often as they are there); an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and labels (given).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices found with gaps, and their labels.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
SHARE = 0.75
GAP = 2
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, list[str], bool]]:
    """``(label, words, base)`` of every template."""
    texts = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, notice, False) for label, notice in NOTICES]
    out = [(label, [x for x in re.split(SPLIT, phrase.lower()) if x], base) for label, phrase, base in texts]
    if any(len(w) > 63 for _, w, _ in out):
        raise ValueError("votes are kept as the bits of a long: a template has at most 63 words")
    return out


def template_grams(spark: SparkSession) -> DataFrame:
    """``(_h, template, at)``: one row per 2-gram; templates -1 and -2 answer
    to the marks that documents with and without words carry."""
    rows = ["(cast(0 as bigint), -1, 0)", "(cast(1 as bigint), -2, 0)"]
    for k, (_, w, _) in enumerate(templates()):
        rows += [f"(xxhash64('{w[i]}', '{w[i + 1]}'), {k}, {i})" for i in range(len(w) - 1)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(_h, template, at)")


def license_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    # lower() would turn the Kelvin sign into an ASCII k
    plain = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    # a text's key: its id and 128 bits of hashes
    key = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"), F.xxhash64(F.lit(1), text).alias("_y")]
    words = docs.select(*key, F.filter(F.split(plain, SPLIT), lambda w: w != "").alias("_w"))
    # the mark behind the last 2-gram also tells the number of words, so no row carries the words
    grams = F.expr(
        "CASE WHEN size(_w) > 1 THEN concat(transform(sequence(0, size(_w) - 2), i -> xxhash64(_w[i], _w[i + 1])), array(0L)) "
        "WHEN size(_w) = 1 THEN array(0L) ELSE array(1L) END"
    )
    one = ["_id", "_x", "_y"]
    rolled = words.select(*one, F.posexplode(grams).alias("_p", "_h"))
    hits = rolled.join(F.broadcast(template_grams(docs.sparkSession)), "_h")
    votes = hits.select(
        *one, "template", F.when(F.col("template") >= 0, F.col("_p") - F.col("at")).alias("_d"), F.expr("shiftleft(1L, at)").alias("_at"),
        F.when(F.col("template") == -1, F.col("_p") + 1).otherwise(0).cast("long").alias("_n"),
    )
    # the marks of equal rows tell how many there are
    diagonals = votes.groupBy(*one, "template", "_d").agg(F.max("_n").alias("n_words"), F.bit_or("_at").alias("_ats"), F.count(F.when(F.col("template") < 0, 1)).alias("_rows"))
    known = templates()
    of = lambda values, other: F.coalesce(F.get(F.array(*[F.lit(x) for x in values]), F.col("template")), F.lit(other))
    base = of([b for _, _, b in known], False)
    length = of([len(w) - 1 for _, w, _ in known], 1)
    per = Window.partitionBy(*one, "template").orderBy("_d")
    step = F.col("_d") - F.lag("_d").over(per)
    new = F.when(base | step.isNull() | (step > GAP), 1).otherwise(0)
    marked = diagonals.withColumn("_new", new).withColumn("_span", F.sum("_new").over(per))
    span = Window.partitionBy(*one, "template", "_span")
    main = F.max_by("_d", F.struct(F.bit_count("_ats"), -F.col("_d"))).over(span)
    near = marked.withColumn("_main", main).where(F.col("_d").isNull() | (F.abs(F.col("_d") - F.col("_main")) <= GAP))
    # at most 2 * GAP + 1 diagonals a span
    spans = near.groupBy(*one, "template", "_span").agg(
        F.max("n_words").alias("n_words"), F.max("_rows").alias("_rows"), F.min("_d").alias("_start"), F.first("_main").alias("_main"),
        F.collect_list(F.struct("_d", "_ats")).alias("_near"),
    ).withColumn("_length", length)
    spans = spans.withColumn("_votes", F.expr(_IN_ORDER))
    spans = spans.withColumn("_cover", F.col("_votes") / F.col("_length")).withColumn("_base", base).withColumn("_label", of([x for x, _, _ in known], ""))
    place = F.col("_base") & (F.col("_cover") == 1)
    found = place | (~F.col("_base") & (F.col("template") >= 0) & (F.col("_cover") >= SHARE))
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("_label")))), ",")
    texts = spans.groupBy(*one).agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("_start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("_start"))).cast("long").alias("last_word"),
        labels(place).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("_cover"))), F.lit(0.0)).alias("score"),
        F.max("_rows").alias("_rows"),
    )
    # two steps, so that no array grows with the number of equal rows
    rows = texts.withColumn("_part", F.explode(F.expr("sequence(0, (_rows - 1) div 65536)")))
    rows = rows.withColumn("_copy", F.explode(F.expr("sequence(1, least(65536, _rows - 65536 * _part))")))
    return rows.drop("_x", "_y", "_rows", "_part", "_copy").withColumnRenamed("_id", id_col)


#: number of a template's 2-grams that stand in order, each at its nearest diagonal
_IN_ORDER = """
CASE WHEN template < 0 THEN 0 ELSE aggregate(
  transform(sequence(0, _length - 1), t -> array_min(transform(filter(_near, x -> shiftright(x._ats, t) & 1 = 1),
    x -> struct(abs(x._d - _main) AS away, x._d + t AS p)))),
  struct(CAST(NULL AS INT) AS last, 0 AS n),
  (s, m) -> IF(m IS NOT NULL AND (s.last IS NULL OR m.p > s.last), struct(CAST(m.p AS INT) AS last, s.n + 1 AS n), s),
  s -> s.n) END
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ROWS = ", ".join(
    f"({k}, '{label}', {str(base).lower()}, {len(w) - 1}, {i}, '{w[i]}', '{w[i + 1]}')"
    for k, (label, w, base) in enumerate(templates())
    for i in range(len(w) - 1)
)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(template, label, base, grams, pos, a, b) AS (VALUES {_ROWS}),
g AS (SELECT r, i, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT r, w, unnest(range(0, len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
v AS MATERIALIZED (SELECT r, template, label, base, grams, pos, i AS p, i - pos AS dg FROM g JOIN t ON g.a = t.a AND g.b = t.b),
dg AS (SELECT r, template, base, dg, count(*) AS votes FROM v GROUP BY ALL),
st AS (SELECT *, dg - lag(dg) OVER (PARTITION BY r, template ORDER BY dg) AS step FROM dg),
sp AS (SELECT *, sum(CASE WHEN base OR step IS NULL OR step > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY r, template ORDER BY dg) AS span FROM st),
ma AS (SELECT *, first_value(dg) OVER (PARTITION BY r, template, span ORDER BY votes DESC, dg) AS main FROM sp),
n AS (SELECT v.*, span, row_number() OVER (PARTITION BY v.r, v.template, span, v.pos ORDER BY abs(v.dg - main), v.p) AS k,
        min(v.dg) OVER (PARTITION BY v.r, v.template, span) AS start
      FROM v JOIN ma ON ma.r = v.r AND ma.template = v.template AND ma.dg = v.dg WHERE abs(v.dg - main) <= {GAP}),
o AS (SELECT *, max(p) OVER (PARTITION BY r, template, span ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n WHERE k = 1),
c AS (SELECT r, template, label, base, span, min(start) AS start, count(*) FILTER (before IS NULL OR p > before) / max(grams) AS cover FROM o GROUP BY ALL),
f AS (SELECT *, base AND cover = 1 AS place FROM c WHERE (base AND cover = 1) OR (NOT base AND cover >= {SHARE})),
x AS (SELECT r, count(*) FILTER (place) AS n, min(start) FILTER (place) AS lo, max(start) FILTER (place) AS hi,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(cover) AS score FROM f GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_base, CAST(x.lo AS BIGINT) AS first_word,
       CAST(x.hi AS BIGINT) AS last_word, coalesce(x.bl, '') AS base_labels, coalesce(x.al, '') AS labels, coalesce(x.score, 0.0) AS score
FROM d LEFT JOIN x ON x.r = d.r
"""
