"""Cells of points are many times the points; they reach their grid by a shuffle, whatever the size of the points' files lets Spark expect."""

import pytest

from gridweave.operators import accuracy, zonal

GRID = [(y, x, float(y * 3 + x)) for y in range(3) for x in range(3)]


@pytest.fixture
def points(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, 0.5, 4), (2, 1.2, 1.9, 0), (3, 9.0, 9.0, 1)], "id long, y double, x double, label int").write.parquet(str(tmp_path / "p"))
    return spark.read.parquet(str(tmp_path / "p"))


@pytest.fixture
def grid(spark):
    return spark.createDataFrame(GRID, "y int, x int, v double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_squares_are_not_broadcast(points, grid):
    out = zonal.zonal(zonal.point_cells(points, 1), grid, ["mean", "count"], "id")
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, 4), (2, 4.0, 9)]


def test_discs_are_not_broadcast(points, grid):
    out = zonal.zonal(zonal.point_cells(points, 2, True), grid, ["max"], "id")
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 6.0), (2, 8.0)]


def test_validation_broadcasts_no_points(points, grid):
    out = accuracy.validate(points, grid, "label", 3)
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 4, 0.0), (2, 0, 0.0)]


def test_homogeneous_validation_broadcasts_no_points(points, grid):
    even = grid.selectExpr("y", "x", "if(y < 2 and x < 2, 7d, v) v")
    out = accuracy.validate(points, even, "label", 3, homogeneous=True)
    assert "Broadcast" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, 4, 7.0)]
