"""Features on grids: points, boxes and polygons meet pixels by equi-joins on cells.

Each feature lists its candidate cells (from its box, so their number is its own area, not the raster's), a ray test keeps those whose
centre it holds, and cells join pixels on (y, x). Statistics are partial aggregates by feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["y", "x"]


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Ray test of a point against a closed ring of (x, y)."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > py) != (b["y"] > py)) & F.coalesce(px < at, F.lit(False))

    return F.aggregate(edges, F.lit(False), lambda s, e: s != crosses(e))


def crossed(x: Column, y: Column, ring: Column) -> Column:
    """Whether an edge of the ring enters the open cell from (x, y) to (x + 1, y + 1): their boxes overlap, and corners of the cell lie on both sides of the edge's line."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def enters(e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = [(b["x"] - a["x"]) * (y + j - a["y"]) - (b["y"] - a["y"]) * (x + i - a["x"]) for i in (0, 1) for j in (0, 1)]
        box = (F.least(a["x"], b["x"]) < x + 1) & (F.greatest(a["x"], b["x"]) > x) & (F.least(a["y"], b["y"]) < y + 1) & (F.greatest(a["y"], b["y"]) > y)
        return box & (F.least(*side) < 0) & (F.greatest(*side) > 0)

    return F.exists(edges, enters)


def on_grid(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells with their pixels, by a shuffle: features' cells are many times what the size of the features lets Spark expect, and would be broadcast."""
    return cells.join(grid.hint("merge"), CELL)


def cells_of(zones: DataFrame, height: int, width: int, touched: bool = False) -> DataFrame:
    """fid, y, x: cells whose centre lies in the zone (touched: also those that an edge crosses). x and y of a cell's centre are its indices + 0.5.
    A zone is a closed `ring`, or `rings`: outer rings, holes and islands, of which an odd number holds a point inside."""
    z = zones.select("fid", ("rings" if "rings" in zones.columns else F.array("ring").alias("rings")))
    box = lambda f, c: f(F.transform(F.flatten("rings"), lambda p: p[c]))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    z = z.select("fid", "rings", *[clip(F.floor(box(f, c)), n).alias(f"{c}{i}") for c, n in (("x", width), ("y", height)) for i, f in enumerate((F.array_min, F.array_max))])
    c = z.select("fid", "rings", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select("fid", "rings", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    test = F.aggregate("rings", F.lit(False), lambda s, r: s != inside(F.col("x") + 0.5, F.col("y") + 0.5, r))
    if touched:
        test = test | F.exists("rings", lambda r: crossed(F.col("x"), F.col("y"), r))
    return c.where(test).select("fid", "y", "x")


def point_cells(points: DataFrame, buffer: int = 0, disc: bool = False) -> DataFrame:
    """id, y, x: the cell of each point, or those around it (a square, or a disc)."""
    from .focal import offsets

    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets(2 * buffer + 1, disc=disc)])
    p = points.select("id", F.floor("y").cast("int").alias("y0"), F.floor("x").cast("int").alias("x0"), F.explode(k).alias("k"))
    return p.select("id", (F.col("y0") + F.col("k.i")).alias("y"), (F.col("x0") + F.col("k.j")).alias("x"))


def sample_points(points: DataFrame, grid: DataFrame, bands: list[str]) -> DataFrame:
    """Each point with the bands of its pixel."""
    return points.withColumns({"__y": F.floor("y").cast("int"), "__x": F.floor("x").cast("int")}).join(grid.select(F.col("y").alias("__y"), F.col("x").alias("__x"), *bands), ["__y", "__x"]).drop("__y", "__x")


RULES = {
    "mean": lambda v, **_: F.avg(v), "stdev": lambda v, **_: F.stddev_pop(v), "median": lambda v, **_: F.median(v), "min": lambda v, **_: F.min(v), "max": lambda v, **_: F.max(v), "sum": lambda v, **_: F.sum(v), "count": lambda v, **_: F.count(v),
    "percentile": lambda v, p=95, **_: F.percentile(v, F.lit(p / 100)),
}


def zonal(cells: DataFrame, grid: DataFrame, rules: list[str], fid: str = "fid", v: str = "v", p: float = 95) -> DataFrame:
    """One row for each feature with a valid pixel: a column for each rule."""
    got = on_grid(cells, grid).where(F.col(v).isNotNull())
    return got.groupBy(fid).agg(*[RULES[r](F.col(v), p=p).alias(r) for r in rules])


def zonal_class(cells: DataFrame, grid: DataFrame, fid: str = "fid", v: str = "v", classes: list | None = None) -> DataFrame:
    """fid, mode (the first listed, else the lowest, wins ties); with classes also count and proportion in % by class."""
    got = cells.join(grid, CELL).where(F.col(v).isNotNull())
    votes = got.groupBy(fid, F.col(v).alias("k")).agg(F.count("*").alias("n"))
    out = votes.groupBy(fid).agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("mode"), *[f for c in classes or [] for f in (F.sum(F.when(F.col("k") == c, F.col("n")).otherwise(0)).alias(f"count{c}"), (F.sum(F.when(F.col("k") == c, F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias(f"proportion{c}"))])
    return out


def all_points(cells: DataFrame, grid: DataFrame) -> DataFrame:
    return cells.join(grid, CELL)


def rasterize(cells: DataFrame, values: DataFrame, fid: str = "fid", value: str = "value") -> DataFrame:
    """y, x, v: the value of the last feature on a cell."""
    return cells.join(values, fid).groupBy(*CELL).agg(F.max_by(value, fid).alias("v"))


def centroid_cells(zones: DataFrame) -> DataFrame:
    """fid, y, x: the cell of the centre of gravity of the ring's area (of its corners, where it has none)."""
    edges = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    area = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e))
    moment = lambda c: F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c]) * cross(e))
    mean = lambda c: F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"][c]) / F.size(edges)
    at = lambda c: F.floor(F.coalesce(F.try_divide(moment(c), 3 * area), mean(c))).cast("int").alias(c)
    return zones.select("fid", at("y"), at("x"))


#: Composites of points that fall in one cell.
POINT_RULES = {
    "last": lambda z: F.max_by(z, F.col("id")), "first": lambda z: F.min_by(z, F.col("id")), "min": F.min, "max": F.max, "absmin": lambda z: F.min_by(z, F.struct(F.abs(z), z)), "absmax": lambda z: F.max_by(z, F.struct(F.abs(z), z)),
    "median": F.median, "mean": F.avg, "var": F.var_pop, "stdev": F.stddev_pop, "sum": F.sum, "number": F.count, "percentile": lambda z: F.percentile(z, F.lit(0.95)), "profile": lambda z: F.sort_array(F.collect_list(z)),
}
RETURNS = {
    "first": lambda: F.col("return_no") == 1, "last": lambda: F.col("return_no") == F.col("n_returns"), "single": lambda: F.col("n_returns") == 1, "multiple": lambda: F.col("n_returns") > 1,
}


def grid_points(points: DataFrame, rules: list[str], attribute: str = "z", dx: float = 1.0, dy: float = 1.0, returns: str | None = None, classes: list | None = None) -> DataFrame:
    """y, x and one column for each rule, from points (id, x, y, ...). profile holds all of a cell's values and suits bounded cells."""
    p = points.where(RETURNS[returns]()) if returns else points
    p = p.where(F.col("class").isin(classes)) if classes else p
    return p.groupBy(F.floor(F.col("y") / dy).cast("int").alias("y"), F.floor(F.col("x") / dx).cast("int").alias("x")).agg(*[POINT_RULES[r](F.col(attribute)).alias(r) for r in rules])
