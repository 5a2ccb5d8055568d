"""Every registered query against its DuckDB equivalent on the smallest tables."""

import math

import duckdb
import pytest

from lumenflow.plans import load_all
from lumenflow.registry import ORACLES, QUERIES

load_all()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def text(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return "0" if abs(v) < 1e-9 else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    ref = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(ref.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    at = [ref.columns.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in ref.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_psnr_is_null_for_equal_planes(spark):
    from pyspark.sql import functions as F

    from lumenflow.operators import kernels as K

    assert spark.range(1).select(K.psnr(F.lit(0.0), 1.0)).first()[0] is None
    assert math.isclose(spark.range(1).select(K.psnr(F.lit(0.01), 1.0)).first()[0], 20.0)


def test_kernels_cover_the_whole_table(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert QUERIES["integral_image_whole"](spark, data).count() == 64 * vectors
    assert QUERIES["covariance_whole"](spark, data).count() == 64 * 65 // 2


@pytest.mark.parametrize("n", [3, 32])
def test_least_squares_of_any_order(spark, n):
    import numpy as np
    from lumenflow.operators import kernels as K

    x = np.random.default_rng(n).normal(size=(200, n))
    y = x @ np.arange(1, n + 1) + 0.1 * np.sin(np.arange(200))
    xs = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame([(k % 2, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], ["k", *xs, "y"])
    for r in K.least_squares(df, "y", xs, ["k"]).collect():
        want = np.linalg.lstsq(x[r["k"] :: 2], y[r["k"] :: 2], rcond=None)[0]
        assert np.allclose([r[f"c_{c}"] for c in xs], want, atol=1e-8)


def test_least_squares_of_a_repeated_variable(spark):
    from lumenflow.operators import kernels as K

    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 3.0), (1, 2.0, 2.0, 1.0, 4.0)], "k int, a double, b double, c double, y double")
    r = K.least_squares(df, "y", ["a", "b", "c"], ["k"]).first()
    assert all(math.isclose(v, w, abs_tol=1e-9) for v, w in zip((r.c_a, r.c_b, r.c_c), (5 / 3, 0, 2 / 3), strict=True))
