"""Codes of positions whose tiles need more digits than the level has."""

from pyspark.sql import functions as F

from gridweave.operators import grid


def test_no_digit_is_lost(spark):
    d = spark.createDataFrame([(48700600.0, 3253700.0), (4321000.0, 12000250.0), (37.0, 5.0)], "x double, y double")
    got = [tuple(r) for r in d.select(*[grid.geo_to_cell(F.col("x"), F.col("y"), level) for level in (9, 10)]).collect()]
    assert got == [("487003253-D", "487003253"), ("432112000-A", "432112000"), ("00000000-A", "00000000")]


def test_boxes_of_far_positions(spark):
    d = spark.createDataFrame([(48700600.0, 3253700.0), (148700600.0, 3253700.0), (4321000.0, 12000250.0), (37.0, 5.0)], "x double, y double")
    for level in (8, 9, 10, 19):
        side, x, y = grid.cell_resolution(level), F.col("x"), F.col("y")
        code, k = grid.geo_to_cell(x, y, level), F.length(grid.tile_digits(x, level))
        for r in d.select("x", "y", grid.cell_box(code, level, k).alias("b"), grid.cell_middle(code, level, k).alias("m")).collect():
            if level < 19:
                ulx, lry = r["x"] // side * side, r["y"] // side * side
                assert tuple(r["b"]) == (ulx, lry + side, ulx + side, lry) and tuple(r["m"]) == (ulx + side / 2, lry + side / 2)
    # without the number of digits, an odd one is of x
    code = grid.geo_to_cell(F.col("x"), F.col("y"), 8)
    assert [r[0] for r in d.where("x < 1e8 and y < 1e7").select(grid.cell_box(code, 8)["ulx"]).collect()] == [48700500, 0]
