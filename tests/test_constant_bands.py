"""Bands that hold one value alone, as large tables make them: results as IEEE arithmetic and the SQL have them, not errors."""

import math

from gridweave.operators import local, stats


def one_value(spark, schema="v double", row=(50.0,), n=20):
    return spark.createDataFrame([row] * n, schema)


def test_kernel_density_of_one_value(spark):
    got = sorted(tuple(r) for r in stats.kernel_density(one_value(spark), 4).collect())
    assert [(b, x) for b, x, _ in got] == [(i, 50.0) for i in range(4)] and all(math.isnan(d) for *_, d in got)
    with_sigma = stats.kernel_density(one_value(spark), 2, 1.0).collect()
    assert all(abs(r["density"] - (2 * math.pi) ** -0.5) < 1e-12 for r in with_sigma)


def test_histogram2d_of_one_value(spark):
    d = spark.createDataFrame([(50.0, 0.0), (50.0, 7.0), (50.0, 8.0)], "a double, b double")
    assert {tuple(r) for r in stats.histogram2d(d, "a", "b", 8).collect()} == {(7, 0, 1), (7, 7, 2)}
    assert {tuple(r) for r in stats.histogram2d(d, "b", "a", 2).collect()} == {(0, 1, 1), (1, 1, 2)}


def test_covariance_of_one_value(spark):
    d = spark.createDataFrame([(50.0, 1.0), (50.0, 3.0), (50.0, None)], "a double, b double")
    for a, b in (("a", "b"), ("b", "a"), ("a", "a")):
        r = stats.covariance(d, a, b).first()
        assert r["cov"] == 0 and math.isnan(r["corr"])
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (9.0, None)], "a double, b double")
    r = stats.covariance(d, "a", "b").first()
    assert abs(r["corr"] - 0.838627869) < 1e-8 and abs(r["cov"] - 8 / 3) < 1e-12
    assert tuple(stats.covariance(d.where("false"), "a", "b").first()) == (None, None)


def test_perpendicular_regression_of_one_value(spark):
    d = spark.createDataFrame([(50.0, 1.0), (50.0, 3.0)], "a double, b double")
    assert all(math.isnan(v) for v in stats.perpendicular_regression(d, "a", "b").first())
    assert all(math.isnan(v) for v in stats.perpendicular_regression(d, "a", "a").first())
    r = stats.perpendicular_regression(d, "b", "a").first()
    assert (r["c1"], r["c0"]) == (0, 50) and math.isnan(r["r2"])
    d = spark.createDataFrame([(1.0, 4.0), (2.0, 2.0), (3.0, 0.0)], "a double, b double")
    r = stats.perpendicular_regression(d, "a", "b").first()
    assert abs(r["c1"] + 4) < 1e-9 and abs(r["c0"] - 10) < 1e-9 and abs(r["r2"] - 1) < 1e-9
    assert tuple(stats.perpendicular_regression(d.where("false"), "a", "b").first()) == (None, None, None)


def test_autoscale_of_one_value(spark):
    d = spark.createDataFrame([(50.0, 1.0), (50.0, 3.0), (None, None)], "a double, b double")
    got = [tuple(r) for r in local.autoscale(d, ["a", "b"], 0.0, 255.0).collect()]
    assert sorted(b for _, b in got if b is not None) == [0, 255] and got.count((None, None)) == 1
    assert sum(a is not None and math.isnan(a) for a, _ in got) == 2
