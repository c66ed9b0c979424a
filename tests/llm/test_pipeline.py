import random

import corpus_pipeline as P
from multitopic.llm import queries

from . import messy
from .test_decontam import brute as leaks
from .test_ngram_join import brute as near
from .test_toxicity_fm import corpus


def write_tables(spark, folder):
    rng = random.Random(12)
    rows, labels = corpus(700)
    rows += [(10_000 + i, t) for i, t in messy.documents()]
    items = [(k, " ".join(messy.sentence(rng, 20, 400))) for k in range(5)]
    rows += [(20_000 + k, " ".join(messy.sentence(rng, 60)) + " " + items[k % 5][1] + " " + " ".join(messy.sentence(rng, 60))) for k in range(20)]
    rows += [(30_000 + k, items[k][1]) for k in range(5)] + [(31_000, rows[0][1]), (31_001, rows[0][1])]
    messy.frame(spark, rows).withColumnRenamed("_w", "n_chars").selectExpr("*", "1 AS `_id2`").withColumn("n_chars", messy_length()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), {i: y for i, _, y in labels}, items


def messy_length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows, toxic, items = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = dict(rows)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(got)
        if name == "toxicity":
            gone = set(kept) - set(got)
            assert sum(toxic.get(i, 0) for i in gone) > 0.8 * sum(toxic.values()) and sum(toxic.get(i, 0) == 0 for i in gone) <= 3
            kept = {i: kept[i] for i in got}
        elif name == "exact_dedup":
            last = {}
            for i, t in kept.items():
                last[t or ""] = max(i, last.get(t or "", i))
            kept = {i: kept[i] for i in last.values()}
        elif name == "ngram_join":
            kept = {i: kept[i] for i, (_, c) in near(list(kept.items())).items() if c == i}
        elif name == "decontamination":
            found = leaks(kept.items(), items)
            kept = {i: t for i, t in kept.items() if found[i][1] <= 0.5 * found[i][0]}
            assert sum(x[4] for x in found.values()) >= 20
            assert not any(x[4] for x in leaks([(i, r.text) for i, r in got.items()], items).values())
            assert all(got[i].text == t for i, t in kept.items() if not found[i][4])
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
        else:
            assert set(got) <= set(kept) and all(1 <= r.copies <= 2 for r in got.values())
            continue
        assert set(got) == set(kept), name
    # "copies" is the one own column that the last stage replaces
    assert {r.score for r in got.values()} == {"own score"}
    assert sorted(r.doc_id for r in P.run(spark, folder).select("doc_id").collect()) == sorted(got)


def test_stages_and_queries_are_registered():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "source_mix"]
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_source_mix_decides_on_rows(spark):
    from multitopic.llm import entropy_mix

    rng = random.Random(41)
    rows = [(k, " ".join(messy.sentence(rng, rng.randrange(5, 60))), f"s{k % 3}") for k in range(300)]
    rows += [(None, " ".join(messy.sentence(rng, rng.randrange(5, 60))), None if k % 2 else "s1") for k in range(60)]
    rows += [(k % 10, " ".join(messy.sentence(rng, 10 + 20 * (k % 7))), f"s{k % 3}") for k in range(90)]  # shared ids
    rows += [rows[0]] * 5 + [(None, None, "s0"), (None, "", "s0")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    mixed = entropy_mix.mix_sources(df).where("copies > 0").collect()
    got = P.source_mix(spark, df, "").collect()
    assert P.source_mix(spark, df, "").columns == [*df.columns, "copies"]
    size = lambda t: len(messy.space_words(t))
    as_rows = lambda x: sorted(map(str, x))
    assert as_rows((r.doc_id, size(r.text), r.source, r.copies) for r in got) == as_rows((r.doc_id, r.size, r.source, r.copies) for r in mixed)
    assert sum(r.doc_id is None for r in got) > 20
