"""Geotransforms: positions, cells and boxes as column expressions; joins of grids as equi-joins on computed cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Upper left corner, cell size (both positive), rows and columns; north is up."""

    ulx: float
    uly: float
    dx: float
    dy: float
    height: int
    width: int

    @property
    def box(self) -> tuple[float, float, float, float]:
        """ulx, uly, lrx, lry."""
        return self.ulx, self.uly, self.ulx + self.width * self.dx, self.uly - self.height * self.dy

    def col(self, x: Column) -> Column:
        """Fractional column of a position."""
        return (x - self.ulx) / self.dx

    def row(self, y: Column) -> Column:
        return (self.uly - y) / self.dy

    def x(self, col: Column) -> Column:
        """Centre of a column."""
        return (col + 0.5) * self.dx + self.ulx

    def y(self, row: Column) -> Column:
        return -((row + 0.5) * self.dy) + self.uly

    def covers(self, x: Column, y: Column) -> Column:
        a, b, c, d = self.box
        return (x > a) & (x < c) & (y > d) & (y < b)

    def cropped(self, ulx: float, uly: float, lrx: float, lry: float, align: bool = False, dx: float | None = None, dy: float | None = None) -> Grid:
        """The grid of a box: aligned ones snap outwards to this grid's lines."""
        dx, dy = dx or self.dx, dy or self.dy
        if align:
            ulx = self.ulx + math.floor((ulx - self.ulx) / dx) * dx
            uly = self.uly - math.floor((self.uly - uly) / dy) * dy
        return Grid(ulx, uly, dx, dy, math.ceil((uly - lry) / dy - 1e-9), math.ceil((lrx - ulx) / dx - 1e-9))


def eu_grid(box: tuple[float, float, float, float], dx: float, dy: float) -> tuple[float, float, float, float]:
    """A box moved outwards to multiples of the cell size."""
    ulx, uly, lrx, lry = box
    return math.floor(ulx / dx) * dx, math.ceil(uly / dy) * dy, math.ceil(lrx / dx) * dx, math.floor(lry / dy) * dy


def overlaps(scenes: DataFrame, ulx: float, uly: float, lrx: float, lry: float) -> DataFrame:
    """Scenes (ulx, uly, lrx, lry) that share area with a box."""
    return scenes.where((F.col("ulx") < lrx) & (F.col("lrx") > ulx) & (F.col("lry") < uly) & (F.col("uly") > lry))


def union_box(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.min("ulx").alias("ulx"), F.max("uly").alias("uly"), F.max("lrx").alias("lrx"), F.min("lry").alias("lry"))


def intersection_box(scenes: DataFrame) -> DataFrame:
    """NULLs where there is none."""
    b = scenes.agg(F.max("ulx").alias("ulx"), F.min("uly").alias("uly"), F.min("lrx").alias("lrx"), F.max("lry").alias("lry"))
    ok = (F.col("ulx") < F.col("lrx")) & (F.col("lry") < F.col("uly"))
    return b.select(*[F.when(ok, F.col(c)).alias(c) for c in b.columns])


def frame(spark, grid: Grid) -> DataFrame:
    """Every cell: y, x."""
    return spark.range(grid.height * grid.width).select(F.floor(F.col("id") / grid.width).cast("int").alias("y"), (F.col("id") % grid.width).cast("int").alias("x"))


def nearest(target: DataFrame, tgrid: Grid, source: DataFrame, sgrid: Grid, bands: list[str]) -> DataFrame:
    """target's cells with the bands of the source cell that holds their centre."""
    t = target.withColumns({"__y": F.floor(sgrid.row(tgrid.y(F.col("y")))).cast("int"), "__x": F.floor(sgrid.col(tgrid.x(F.col("x")))).cast("int")})
    return t.join(source.select(F.col("y").alias("__y"), F.col("x").alias("__x"), *bands), ["__y", "__x"]).drop("__y", "__x")


def bilinear(target: DataFrame, tgrid: Grid, source: DataFrame, sgrid: Grid, band: str) -> DataFrame:
    """y, x, band: from the four source centres around each target centre; missing ones give up their weight."""
    t = target.select("y", "x", (sgrid.row(tgrid.y(F.col("y"))) - 0.5).alias("r"), (sgrid.col(tgrid.x(F.col("x"))) - 0.5).alias("c"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("k")
    t = t.select("y", "x", "r", "c", corner)
    t = t.withColumns({"__y": (F.floor("r") + F.col("k.i")).cast("int"), "__x": (F.floor("c") + F.col("k.j")).cast("int")})
    w = (1 - F.abs(F.col("r") - F.col("__y"))) * (1 - F.abs(F.col("c") - F.col("__x")))
    got = t.withColumn("w", w).where("w > 0").join(source.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col(band).alias("v")), ["__y", "__x"])
    return got.groupBy("y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(band))


def crop(source: DataFrame, sgrid: Grid, to: Grid, bands: list[str], fill: float | None = None, method: str = "near") -> DataFrame:
    """y, x (of the new grid), bands: every cell of the new grid."""
    cells = frame(source.sparkSession, to)
    got = nearest(cells, to, source, sgrid, bands) if method == "near" else bilinear(cells, to, source, sgrid, bands[0])
    return cells.join(got, ["y", "x"], "left").select("y", "x", *[F.coalesce(F.col(b), F.lit(fill)).alias(b) if fill is not None else F.col(b) for b in bands])


def stack(rasters: list[DataFrame], bands: list[list[str]]) -> DataFrame:
    """Bands of several rasters of one grid side by side."""
    out, k = None, 0
    for r, names in zip(rasters, bands):
        r = r.select("y", "x", *[F.col(b).alias(f"b{k + i}") for i, b in enumerate(names)])
        k += len(names)
        out = r if out is None else out.join(r, ["y", "x"])
    return out


# --- cell codes: digits of the tile's x and y, then a letter for each halving; positions beyond seven digits have more --
# A: west and south; B: east; C: north; D: east and north.


def cell_shape(level: int) -> tuple[int, int, int]:
    """Tile size, digits a coordinate, halvings; levels 19, 16, 13 ... are whole tiles of coordinates of seven digits."""
    n = (level + 1) // 3
    return 10**n, 7 - n, (19 - level) % 3


def cell_resolution(level: int) -> float:
    size, _, halvings = cell_shape(level)
    return size / 2**halvings


def tile_digits(x: Column, level: int) -> Column:
    """Of the tile of a coordinate: as many as the level has, or as it needs."""
    size, digits, _ = cell_shape(level)
    tile = F.floor(x / size).cast("string")
    return F.when(F.length(tile) < digits, F.lpad(tile, digits, "0")).otherwise(tile)


def geo_to_cell(x: Column, y: Column, level: int) -> Column:
    size, _, halvings = cell_shape(level)
    parts = [tile_digits(x, level), tile_digits(y, level)]
    for k in range(halvings):
        half = size / 2**k
        east, north = F.pmod(x, F.lit(half)) >= half / 2, F.pmod(y, F.lit(half)) >= half / 2
        letter = F.when(east & north, "D").when(east, "B").when(north, "C").otherwise("A")
        parts += [F.lit("-")] * (k == 0) + [letter]
    return F.concat(*parts)


def cell_box(code: Column, level: int, x_digits: Column | None = None) -> Column:
    """ulx, uly, lrx, lry. A code does not say how many of its digits are of x: half of them (and an odd one), as far as positions have seven digits, else x_digits."""
    size, _, halvings = cell_shape(level)
    tile = F.length(code) - (halvings + 1 if halvings else 0)
    many = F.ceil(tile / 2).cast("int") if x_digits is None else x_digits
    x, y = F.substring(code, F.lit(1), many).cast("double") * size, F.substring(code, many + 1, tile - many).cast("double") * size
    for k in range(halvings):
        letter, half = F.substring(code, tile + 2 + k, F.lit(1)), size / 2 ** (k + 1)
        x, y = x + F.when(letter.isin("B", "D"), half).otherwise(0.0), y + F.when(letter.isin("C", "D"), half).otherwise(0.0)
    r = cell_resolution(level)
    return F.struct(x.alias("ulx"), (y + r).alias("uly"), (x + r).alias("lrx"), y.alias("lry"))


def cell_middle(code: Column, level: int, x_digits: Column | None = None) -> Column:
    b = cell_box(code, level, x_digits)
    return F.struct(((b["ulx"] + b["lrx"]) / 2).alias("x"), ((b["uly"] + b["lry"]) / 2).alias("y"))
