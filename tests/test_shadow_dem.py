"""Shadows as long as heights make them; ground filters refuse names that they don't know."""

import pytest

from gridweave.operators import focal as O


def test_shadow_is_as_long_as_the_height(spark):
    rows = [(y, 0, 30.0 if y == 0 else 0.0) for y in range(40)]
    g = spark.createDataFrame(rows, "y int, x int, v double")
    one = {r["y"] for r in O.shadow(g, 45.0, 0.0).collect() if r["shadow"]}
    assert one == set(range(1, 30))
    half = {r["y"] for r in O.shadow(g, 45.0, 0.0, pixel=2.0).collect() if r["shadow"]}
    assert half == set(range(1, 15))


def test_unknown_ground_filter(spark):
    g = spark.createDataFrame([(0, 0, 1.0)], "y int, x int, v double")
    with pytest.raises(ValueError):
        O.dem_filter(g, "vito", 1, 1)
