import math

import duckdb
import numpy as np

from multitopic.functions import special as S


def test_numpy_values():
    assert abs(S.digamma_np(1.0) + 0.5772156649015329) < 1e-12
    assert abs(S.trigamma_np(1.0) - math.pi ** 2 / 6) < 1e-12
    # published values, outside of this library
    for x, d, t in ((0.5, -1.9635100260214235, math.pi**2 / 2), (2.0, 0.42278433509846714, math.pi**2 / 6 - 1), (10.0, 2.251752589066721, 0.10516633568168575), (0.25, -4.2274535333762654, 17.19732915450711)):
        assert abs(S.digamma_np(x) - d) < 1e-11 and abs(S.trigamma_np(x) - t) < 1e-9
    xs = np.array([1e-4, 0.01, 0.3, 1.0, 2.5, 7.0, 30.0, 1e3, 1e6])
    ref = np.array([math.lgamma(v) for v in xs])
    assert np.max(np.abs(S.lgamma_np(xs) - ref) / np.maximum(1.0, np.abs(ref))) < 1e-12
    # recurrence psi(x + 1) = psi(x) + 1/x
    assert np.allclose(S.digamma_np(xs + 1), S.digamma_np(xs) + 1 / xs, rtol=0, atol=1e-10)


def test_sql_matches_numpy_in_spark_and_duckdb(spark):
    xs = [0.01, 0.5, 1.0, 3.0, 12.5, 400.0]
    df = spark.createDataFrame([(float(x),) for x in xs], "x DOUBLE")
    rows = df.select("x", S.digamma_col("x").alias("d"), S.trigamma_col("x").alias("t"), S.lgamma_col("x").alias("l")).collect()
    for r in rows:
        assert abs(r["d"] - S.digamma_np(r["x"])) < 1e-12
        assert abs(r["t"] - S.trigamma_np(r["x"])) < 1e-10
        assert abs(r["l"] - math.lgamma(r["x"])) < 1e-10
    for x in xs:
        d, t, lg = duckdb.sql(f"SELECT {S.digamma_sql('x')}, {S.trigamma_sql('x')}, {S.lgamma_sql('x')} FROM (SELECT {x}::DOUBLE AS x)").fetchall()[0]
        assert abs(d - S.digamma_np(x)) < 1e-12 and abs(t - S.trigamma_np(x)) < 1e-10 and abs(lg - math.lgamma(x)) < 1e-10


def test_dirichlet_expectation_rows():
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    e = S.dirichlet_expectation_np(a)
    assert np.allclose(e[0], S.digamma_np(a[0]) - S.digamma_np(3.0))
