"""Focal operators: windows over neighbouring pixels.

A pixel sends its value to the cells whose window holds it (an explode of the kernel's offsets) and one aggregation by cell, with
partial sums on the map side, gathers them: one shuffle and no join. Edges mirror. Reads: y, x, v (NULL: nodata).
Rasters are dealt by cell, so no tile or row is special and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import durable

KEY = ["y", "x"]


def offsets(dy: int, dx: int | None = None, disc: bool = False) -> list[tuple[int, int]]:
    """Window offsets; a disc keeps i*i + j*j <= (dx // 2) * (dy // 2)."""
    dx = dx or dy
    out = [(i, j) for i in range(-(dy // 2), dy // 2 + 1) for j in range(-(dx // 2), dx // 2 + 1)]
    return [(i, j) for i, j in out if not disc or i * i + j * j <= (dx // 2) * (dy // 2)]


def _centres(k: Column, d: Column, n: int) -> Column:
    """Where the window's centre lies if place k is d from it, directly or folded at an edge."""
    straight, low, high = k - d, -k - d, 2 * (n - 1) - k - d
    inside = lambda c: (c >= 0) & (c < n)
    return F.array_compact(F.array(F.when(inside(straight), straight), F.when(inside(low) & (low + d < 0), low), F.when(inside(high) & (high + d >= n), high)))


def windows(g: DataFrame, height: int, width: int, cells: list[tuple[int, int]], taps: dict | None = None) -> DataFrame:
    """y, x (of the centre), v, di, dj, tap: every member of every window; c: v in the row of the centre itself, else NULL."""
    k = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(float(taps[i, j]) if taps else 1.0).alias("tap")) for i, j in cells])
    sent = g.select("y", "x", "v", F.explode(k).alias("k")).select("y", "x", "v", "k.*")
    sent = sent.select(F.explode(_centres(F.col("y"), F.col("di"), height)).alias("cy"), "x", "v", "di", "dj", "tap")
    sent = sent.select(F.col("cy").alias("y"), F.explode(_centres(F.col("x"), F.col("dj"), width)).alias("x"), "v", "di", "dj", "tap")
    return sent.withColumn("c", F.when((F.col("di") == 0) & (F.col("dj") == 0), F.col("v")))


def _gather(w: DataFrame, *columns: Column) -> DataFrame:
    """One row for each centre that is a pixel itself."""
    here = F.count_if((F.col("di") == 0) & (F.col("dj") == 0))
    return w.groupBy(*KEY).agg(*columns, here.alias("__here")).where("__here > 0").drop("__here")


def _first(c: str) -> Column:
    return F.first(c, ignorenulls=True)


#: Results by name; each may use the window's values v and the centre c.
METHODS = {
    "nvalid": lambda **_: F.count("v"), "median": lambda **_: F.median("v"), "var": lambda **_: F.var_pop("v"), "stdev": lambda **_: F.stddev_pop("v"), "mean": lambda **_: F.avg("v"), "smooth": lambda **_: F.avg("v"),
    "min": lambda **_: F.min("v"), "max": lambda **_: F.max("v"), "sum": lambda **_: F.sum("v"), "erode": lambda **_: F.when(_first("c").isNotNull(), F.min("v")), "dilate": lambda **_: F.when(_first("c").isNotNull(), F.max("v")),
    "ismin": lambda **_: (F.min("v") == _first("c")).cast("int"), "ismax": lambda **_: (F.max("v") == _first("c")).cast("int"),
    "minmax": lambda **_: F.when(F.min("v") == F.max("v"), _first("c")).otherwise(0.0),
    "order": lambda **_: F.coalesce(F.floor(F.try_divide(F.count("v") * (_first("c") - F.min("v")), F.max("v") - F.min("v"))), F.lit(0)).cast("short"),
    "percentile": lambda p=95, **_: F.percentile("v", F.lit(p / 100)),
    "proportion": lambda **_: F.try_divide(F.lit(100.0) * _first("c"), F.sum("v")),
    "homog": lambda **_: F.when(F.min("v") == F.max("v"), _first("c")),
    "heterog": lambda **_: F.when(F.count_distinct("v") == F.count("v"), _first("c")),
    "density": lambda classes, **_: F.count_if(F.col("v").isin(classes)) * 100.0 / F.count("v"),
    "countid": lambda **_: F.count_distinct("v"),
    "smoothnodata": lambda **_: F.coalesce(_first("c"), F.avg("v")),
    "sauvola": lambda k=0.5, r=128.0, **_: F.when(_first("c") > F.avg("v") * (1 + k * (F.stddev_pop("v") / r - 1)), F.lit(1)),
    "convolve": lambda absolute=False, normalize=False, **_: _convolved(absolute, normalize),
    "scramble": lambda seed=1, **_: F.min_by("v", F.xxhash64(F.lit(seed), "y", "x", "di", "dj")),
}


def _convolved(absolute: bool, normalize: bool) -> Column:
    s = F.sum(F.col("tap") * F.col("v"))
    s = F.abs(s) if absolute else s
    norm = F.sum(F.when(F.col("v").isNotNull(), F.col("tap")))
    return F.when(F.abs(norm) > 1e-12, s / norm).otherwise(s) if normalize else s


def focal(g: DataFrame, method: str, height: int, width: int, size: int = 3, disc: bool = False, taps: dict | None = None, down: int = 1, **options) -> DataFrame:
    """y, x, v: METHODS[method] over each window. down keeps the rows and columns with (k + 1 + down // 2) % down == 0."""
    cells = list(taps) if taps else offsets(size, disc=disc)
    if down > 1:
        keep = lambda c: (F.col(c) + 1 + down // 2) % down == 0
        w = windows(g, height, width, cells, taps).where(keep("y") & keep("x"))
    else:
        w = windows(g, height, width, cells, taps)
    return _gather(w, METHODS[method](**options).alias("v"))


def focal_mode(g: DataFrame, height: int, width: int, size: int = 3, disc: bool = False, priors: dict | None = None) -> DataFrame:
    """The value of most votes; ties go to the centre, then to the lowest. priors: weight by class (majority voting)."""
    w = windows(g, height, width, offsets(size, disc=disc))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in priors.items() for x in kv])[F.col("v")], F.lit(0.0)) if priors else F.lit(1.0)
    here = (F.col("di") == 0) & (F.col("dj") == 0)
    votes = w.groupBy(*KEY, F.col("v").alias("k")).agg(F.sum(weight).alias("n"), F.coalesce(F.max((F.col("v") == F.col("c")).cast("int")), F.lit(0)).alias("own"), F.max(here).alias("here"))
    order = F.when(F.col("k").isNotNull(), F.struct("n", "own", -F.col("k")))
    return votes.groupBy(*KEY).agg(F.max_by("k", order).alias("v"), F.max("here").alias("here")).where("here").drop("here")


def focal_threshold(g: DataFrame, height: int, width: int, classes: list[float], shares: list[float], size: int = 3) -> DataFrame:
    """A class whose share in % exceeds its threshold replaces the centre; later classes override."""
    w = windows(g, height, width, offsets(size))
    v = _first("c")
    for c, t in zip(classes, shares):
        v = F.when(F.count_if(F.col("v") == c) * 100.0 / F.count("v") > t, F.lit(float(c))).otherwise(v)
    return _gather(w, v.alias("v"))


#: Land-cover codes of the mixed rule.
BROADLEAF, CONIFER, MIXED_FOREST, NON_FOREST, WATER = 11, 12, 13, 20, 30


def focal_mixed(g: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    """Fuses forest classes. Forest, where its classes are as many as the others together: of the kind that makes up 75 % of broadleaf and
    conifer, else mixed. Elsewhere water, where it is as frequent as other non-forest."""
    n = {c: F.count_if(F.col("v") == c) for c in (BROADLEAF, CONIFER, MIXED_FOREST, NON_FOREST, WATER)}
    forest, pure = n[BROADLEAF] + n[CONIFER] + n[MIXED_FOREST], n[BROADLEAF] + n[CONIFER]
    kind = F.when((pure > 0) & (n[BROADLEAF] >= 0.75 * pure), BROADLEAF).when((pure > 0) & (n[CONIFER] >= 0.75 * pure), CONIFER).otherwise(MIXED_FOREST)
    other = F.when((n[WATER] > 0) & (n[WATER] >= n[NON_FOREST]), WATER).otherwise(NON_FOREST)
    v = F.when((forest > 0) & (forest >= n[NON_FOREST] + n[WATER]), kind).otherwise(other)
    return _gather(windows(g, height, width, offsets(size)), v.cast("double").alias("v"))


#: 3 x 3 edge kernels.
SOBEL = {
    "sobelx": [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]],
    "sobely": [[1, 2, 1], [0, 0, 0], [-1, -2, -1]],
    "sobelxy": [[0, 1, 2], [-1, 0, 1], [-2, -1, 0]],
    "sobelyx": [[2, 1, 0], [1, 0, -1], [0, -1, -2]],
}


def taps_of(rows: list[list[float]]) -> dict:
    h, w = len(rows), len(rows[0])
    return {(i - h // 2, j - w // 2): v for i, r in enumerate(rows) for j, v in enumerate(r)}


def sobel(g: DataFrame, name: str, height: int, width: int) -> DataFrame:
    return focal(g, "convolve", height, width, taps=taps_of(SOBEL[name]), absolute=True, normalize=True)


def opened(g: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    return focal(focal(g, "erode", height, width, size), "dilate", height, width, size)


def closed(g: DataFrame, height: int, width: int, size: int = 3) -> DataFrame:
    return focal(focal(g, "dilate", height, width, size), "erode", height, width, size)


def morphology_if(g: DataFrame, method: str, height: int, width: int, size: int, least: float) -> DataFrame:
    """y, x, v, changed: dilation or erosion where it moves the value by more than `least`."""
    w = _gather(windows(g, height, width, offsets(size)), _first("c").alias("c"), (F.max("v") if method == "dilate" else F.min("v")).alias("e"))
    moved = F.abs(F.col("e") - F.col("c")) > least
    return w.select(*KEY, F.when(moved, F.col("e")).otherwise(F.col("c")).alias("v"), moved.cast("int").alias("changed"))


def class_prior(g: DataFrame, height: int, width: int, classes: list[float], beta: float | list[list[float]], size: int = 3, eight: bool = True) -> DataFrame:
    """Markov-field priors of each class: exp of minus the neighbours of every other listed class, each times beta[class][other], normalised; one column a
    class. One beta serves all pairs. eight=False: neighbours in the same row or column alone."""
    k = range(len(classes))
    weight = beta if isinstance(beta, list) else [[beta] * len(classes)] * len(classes)
    cells = [(i, j) for i, j in offsets(size) if eight or not i or not j]
    w = _gather(windows(g, height, width, cells), *[F.count_if(((F.col("di") != 0) | (F.col("dj") != 0)) & (F.col("v") == c)).alias(f"n{i}") for i, c in enumerate(classes)])
    e = [F.exp(-sum((F.col(f"n{j}") * float(weight[i][j]) for j in k if j != i), F.lit(0.0))) for i in k]
    w = w.select(*KEY, *[x.alias(f"e{i}") for i, x in enumerate(e)])
    total = sum((F.col(f"e{i}") for i in k[1:]), F.col("e0"))
    return w.select(*KEY, *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in k])


def shift(g: DataFrame, dy: float, dx: float, bilinear: bool = False) -> DataFrame:
    """v at (y, x) becomes that at (y - dy, x - dx): the nearest pixel, or the four around, weighted."""
    if not bilinear:
        return g.select((F.col("y") + round(dy)).cast("int").alias("y"), (F.col("x") + round(dx)).cast("int").alias("x"), "v")
    import math

    fy, fx = dy - math.floor(dy), dx - math.floor(dx)
    parts = [(i, j, (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]
    k = F.array(*[F.struct(F.lit(i + math.floor(dy)).alias("i"), F.lit(j + math.floor(dx)).alias("j"), F.lit(w).alias("w")) for i, j, w in parts if w])
    e = g.where("v is not null").select("y", "x", "v", F.explode(k).alias("k"))
    e = e.groupBy((F.col("y") + F.col("k.i")).alias("y"), (F.col("x") + F.col("k.j")).alias("x")).agg((F.sum(F.col("v") * F.col("k.w")) / F.sum("k.w")).alias("v"), F.sum("k.w").alias("w"))
    return e.where("w > 0.999").drop("w")


def shadow(height_map: DataFrame, sun_zenith: float, sun_azimuth: float, pixel: float = 1.0) -> DataFrame:
    """y, x, shadow: 1 where a cell lies below the line from a higher cell's top along the sun's rays. A shadow has as many cells as its height makes it, its own
    cell among them; cells along it are found by cutting off fractions."""
    import math

    sin, cos = round(math.sin(math.radians(sun_azimuth)), 12), round(math.cos(math.radians(sun_azimuth)), 12)
    slope = math.tan(math.radians(sun_zenith))
    cast = height_map.where("v is not null").withColumn("n", F.floor(F.abs(F.col("v") * slope) / pixel + 1e-9).cast("int")).where("n > 1")
    cast = cast.select(F.col("y").alias("y0"), F.col("x").alias("x0"), "v", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("d"))
    y, x = (F.col("y0") + F.col("d") * cos).cast("int"), (F.col("x0") - F.col("d") * sin).cast("int")  # towards zero
    top = cast.groupBy(y.alias("y"), x.alias("x")).agg(F.max(F.col("v") - F.col("d") * (pixel / slope)).alias("top"))
    return height_map.join(top, KEY, "left").select(*KEY, F.coalesce((F.col("top") > F.col("v")).cast("int"), F.lit(0)).alias("shadow"))


def _per_tile(f):
    """A numpy function of one whole raster (NaN: nodata), for applyInPandas by scene."""

    def run(t):
        import numpy as np
        import pandas as pd

        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        a = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        a[y - y0, x - x0] = t["v"].to_numpy(float)
        out = f(a)
        i, j = np.indices(out.shape)
        keep = ~np.isnan(out)
        return pd.DataFrame({"scene": int(t["scene"].iloc[0]), "y": (i[keep] + y0).astype("int32"), "x": (j[keep] + x0).astype("int32"), "v": out[keep]})

    return run


def per_tile(tiles: DataFrame, f) -> DataFrame:
    """Sequential or global functions, a tile (scene, y, x, v) at a time: tiles bound their memory."""
    return tiles.groupBy("scene").applyInPandas(_per_tile(f), "scene int, y int, x int, v double")


def haar2d(a, inverse: bool = False):
    """One level of the orthonormal 2-D Haar wavelet; odd sizes repeat their last line."""
    import numpy as np

    a = np.nan_to_num(a)
    a = np.pad(a, [(0, n % 2) for n in a.shape], mode="edge")
    r = np.sqrt(2.0)
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        n = len(a) // 2
        if inverse:
            b = np.empty_like(a)
            b[0::2], b[1::2] = (a[:n] + a[n:]) / r, (a[:n] - a[n:]) / r
        else:
            b = np.concatenate([(a[0::2] + a[1::2]) / r, (a[0::2] - a[1::2]) / r])
        a = np.moveaxis(b, 0, axis)
    return a


def wavelet_cut(a, keep: float):
    """Transformed, with coefficients below the percentile `keep` of their magnitudes set to zero, and back."""
    import numpy as np

    c = haar2d(a)
    c[np.abs(c) < np.percentile(np.abs(c), keep)] = 0
    return haar2d(c, True)[: a.shape[0], : a.shape[1]]


PASSES = ("nwse", "nesw", "senw", "swne")


def ground_pass(a, rise: float, limit: int, size: int = 3, direction: str = "nwse"):
    """One directional surface-to-ground pass: True where at most `limit` cells of the window lie lower by more than `rise`. Any other cell takes the second lowest value
    of its neighbours before the scan goes on, so what a building hides shows. Cells are done in wavefronts whose members don't see each other. Windows mirror; NaN counts as no neighbour."""
    import numpy as np

    flip = {"nwse": np.s_[:, :], "nesw": np.s_[:, ::-1], "senw": np.s_[::-1, ::-1], "swne": np.s_[::-1, :]}[direction]
    b, r = np.array(a, float)[flip].copy(), size // 2
    h, w = b.shape
    ground = np.zeros((h, w), bool)
    mirror = lambda k, n: np.clip(np.where(k < 0, -k, np.where(k >= n, 2 * (n - 1) - k, k)), 0, n - 1)
    around = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i or j]
    for front in range((r + 1) * (h - 1) + w):
        y = np.arange(max(0, -(-(front - w + 1) // (r + 1))), min(h - 1, front // (r + 1)) + 1)
        x = front - (r + 1) * y
        near = np.stack([b[mirror(y + i, h), mirror(x + j, w)] for i, j in around])
        lower = (b[y, x] - near > rise).sum(0)
        ground[y, x] = (lower <= limit) & ~np.isnan(b[y, x])
        second = np.sort(near, axis=0)[min(1, len(near) - 1)]  # NaN sorts last
        b[y, x] = np.where(ground[y, x] | np.isnan(second), b[y, x], second)
    return ground[flip]


#: thresholds' limits of the four-pass mask.
LIMITS = (2, 3, 2, 0)


def ground_mask(a, rises=(0.7, 0.3, 0.1, -0.2), size: int = 3):
    """0 where a pass in any direction, at any threshold, finds ground, else 1 (NaN: nodata)."""
    import numpy as np

    out = np.ones(a.shape)
    for rise, limit in zip(rises, LIMITS):
        for direction in PASSES:
            out[ground_pass(a, rise, limit, size, direction)] = 0
    return np.where(np.isnan(a), np.nan, out)


def linear_features(a, step: float = 1.0, distance: float = 0.0, eps: float = 0.0, angle: float | None = None):
    """(longest, its angle, shortest, its angle) through each cell: how many cells in a row, to either side, differ from it by eps at most, over
    angles from north (0) to below 180 in steps, or one angle alone. A ray ends before `distance` cells (0: the square root of the raster's), and at the edge.
    The first angle wins ties; a cell without any line has longest 0 and shortest 0."""
    import numpy as np

    h, w = a.shape
    distance = distance if distance > 0 else np.sqrt(h * w)
    y, x = np.indices((h, w))
    longest, shortest, at_l, at_s = np.zeros((h, w)), np.full((h, w), float(distance)), np.zeros((h, w)), np.zeros((h, w))
    for north in np.arange(0.0, 180.0, step) if angle is None else [angle]:
        n = np.zeros((h, w))
        for side in (0, 1):
            to = np.pi / 2 - np.radians(north) + side * np.pi
            sin, cos = round(float(np.sin(to)), 12), round(float(np.cos(to)), 12)
            on, ray = ~np.isnan(a), 1
            while ray < distance and on.any():
                yy, xx = np.trunc(y - ray * sin).astype(int), np.trunc(x + ray * cos).astype(int)
                on &= (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                on &= np.abs(a[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)] - a) <= eps
                n += on
                ray += 1
        at_l[n > longest], at_s[n < shortest] = north, north
        longest, shortest = np.maximum(longest, n), np.minimum(shortest, n)
    return tuple(np.where(np.isnan(a), np.nan, v) for v in (longest, at_l, shortest, at_s))


def dem_filter(g: DataFrame, method: str, height: int, width: int, size: int = 3, largest: int = 17, rise: float = 0.2, slope: float = 0.0, top: float | None = None, pixel: float = 1.0, least: int = 0) -> DataFrame:
    """Surface to ground, by morphology that applies where it moves a value by more than a threshold; rounds go on while over `least` cells change and the window is not
    above `largest`. open, close: one round at `rise`. etew_min: erosion, windows grow by two, the threshold is slope * window. promorph: erosion, dilation and median,
    windows go 3, 5, 9, 17, ..., the threshold is rise + slope * growth of the window * pixel, `top` at most."""
    if method not in ("open", "close", "promorph", "etew_min"):
        raise ValueError(f"unknown method {method!r}")
    if method in ("open", "close"):
        for m in ("erode", "dilate") if method == "open" else ("dilate", "erode"):
            g = morphology_if(g, m, height, width, size, rise).drop("changed")
        return g
    n, threshold = size, rise
    while n <= largest:
        low = durable(morphology_if(g, "erode", height, width, n, slope * n if method == "etew_min" else threshold))
        changed = low.agg(F.sum("changed")).first()[0] or 0
        g = low.drop("changed")
        if method == "etew_min":
            n += 2
        else:
            g = durable(focal(morphology_if(g, "dilate", height, width, n, threshold).drop("changed"), "median", height, width, n))
            grown = 3 if n == 1 else 2 * (n - 1) + 1
            threshold = rise + slope * (grown - n) * pixel
            threshold, n = (min(threshold, top) if top is not None else threshold), grown
        if changed <= least:
            break
    return g
