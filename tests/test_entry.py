"""Driver contract: entry(), queries() and oracle_sql() (one query per
operator family checked against DuckDB at sf0.001)."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"doc_id", "topic", "p"}
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize(
    "name", ["vocabulary", "estep_gamma", "sstats_estep", "train_online_2chunks", "bound", "topic_terms", "topic_diff_js", "vis_saliency"]
)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    cols = sorted(sp.columns)
    a = sp[cols].sort_values(cols).reset_index(drop=True)
    b = dk[cols].sort_values(cols).reset_index(drop=True)
    for c in cols:
        if a[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
