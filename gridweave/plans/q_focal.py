"""Focal operators on one scene's grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import focal as O
from ..registry import query
from . import fixtures as X

N = X.SIDE
_F = "CASE WHEN {k} < 0 THEN -{k} WHEN {k} >= 32 THEN 62 - {k} ELSE {k} END"


def _window(size: int, g: str = "g", name: str = "w") -> str:
    """Members v of each window; c: the centre."""
    h = size // 2
    return f"{name} AS (SELECT a.y, a.x, a.v AS c, b.v AS v, i.d AS di, j.d AS dj FROM {g} a, range(-{h}, {h + 1}) i(d), range(-{h}, {h + 1}) j(d), {g} b WHERE b.y = {_F.format(k='(a.y + i.d)')} AND b.x = {_F.format(k='(a.x + j.d)')})"


def _q(name: str, expr: str, method: str, size: int = 3, disc: bool = False, digits: int | None = 6, band: str = "b0", **options) -> None:
    where = f"WHERE di * di + dj * dj <= {(size // 2) ** 2}" if disc else ""
    g = X.GRID.replace("b0", band)
    sql = X.sql(X.PIXELS, g, _window(size), f"SELECT y, x, {f'round({expr}, {digits})' if digits else expr} AS v FROM w {where} GROUP BY y, x")

    def run(s, d):
        out = O.focal(X.grid(s, d, band=band), method, N, N, size, disc, **options)
        return out.select("y", "x", F.round("v", digits).alias("v")) if digits else out

    query(name, sql)(run)


_q("o093_focal_nvalid", "count(v)", "nvalid", digits=None)
for _m, _e in {"mean": "avg(v)", "median": "median(v)", "var": "var_pop(v)", "stdev": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)"}.items():
    _q(f"o094_focal_{_m}", _e, _m)
_q("o094_focal_mean_disc", "avg(v)", "mean", 5, True)
_q("o095_focal_ismin", "CAST(min(v) = any_value(c) AS INTEGER)", "ismin", digits=None)
_q("o095_focal_ismax", "CAST(max(v) = any_value(c) AS INTEGER)", "ismax", digits=None)
_q("o096_focal_minmax", "CASE WHEN min(v) = max(v) THEN any_value(c) ELSE 0.0 END", "minmax", band="b2")
_q("o097_focal_order", "CAST(coalesce(floor(count(v) * (any_value(c) - min(v)) / nullif(max(v) - min(v), 0)), 0) AS SMALLINT)", "order", digits=None)
_q("o098_focal_percentile", "quantile_cont(v, 0.9)", "percentile", p=90)
_q("o099_focal_proportion", "100.0::DOUBLE * any_value(c) / nullif(sum(v), 0)", "proportion")
_q("o100_focal_homog", "CASE WHEN min(v) = max(v) THEN any_value(c) END", "homog", band="b2", digits=None)
_q("o100_focal_heterog", "CASE WHEN count(DISTINCT v) = count(v) THEN any_value(c) END", "heterog", digits=None)
_q("o101_focal_density", "count_if(v IN (1, 2)) * 100.0::DOUBLE / count(v)", "density", band="b2", classes=[1.0, 2.0])
_q("o102_focal_countid", "count(DISTINCT v)", "countid", band="b2", digits=None)
_q("o107_focal_sauvola", "CASE WHEN any_value(c) > avg(v) * (1 + 0.5::DOUBLE * (stddev_pop(v) / 128 - 1)) THEN 1 END", "sauvola", digits=None)
_q("o110_focal_smooth", "avg(v)", "smooth", 5)
_q("o111_dilate", "max(v)", "dilate")
_q("o111_erode", "min(v)", "erode")
_q("o111_dilate_disc", "max(v)", "dilate", 5, True)
_TAPS = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
_TAP = "(CASE WHEN di = 0 THEN 2 ELSE 1 END * CASE WHEN dj = 0 THEN 2 ELSE 1 END)"
_q("o108_convolution", f"sum(v * {_TAP}) / sum({_TAP})", "convolve", taps=O.taps_of(_TAPS), normalize=True)
for _name, _rows in O.SOBEL.items():
    _case = "CASE " + " ".join(f"WHEN di = {i - 1} AND dj = {j - 1} THEN {v}" for i, r in enumerate(_rows) for j, v in enumerate(r)) + " END"
    query(f"o109_{_name}", X.sql(X.PIXELS, X.GRID, _window(3), f"SELECT y, x, round(abs(sum(v * {_case})) / coalesce(nullif(sum({_case}), 0), 1), 6) AS v FROM w GROUP BY y, x"))(lambda s, d, n=_name: O.sobel(X.grid(s, d), n, N, N).select("y", "x", F.round("v", 6).alias("v")))

_MODE = "m AS (SELECT y, x, v AS k, count(*) AS n, max(CAST(v = c AS INTEGER)) AS own FROM w GROUP BY y, x, v)"
_B2 = X.GRID.replace("b0", "b2")
query("o103_focal_mode", X.sql(X.PIXELS, _B2, _window(3), _MODE, "SELECT y, x, arg_max(k, row(n, own, -k)) AS v FROM m GROUP BY y, x"))(lambda s, d: O.focal_mode(X.grid(s, d, band="b2"), N, N))
query("o104_focal_threshold", X.sql(X.PIXELS, _B2, _window(3), "SELECT y, x, CASE WHEN count_if(v = 5) * 100.0 / count(v) > 20 THEN 5.0 WHEN count_if(v = 9) * 100.0 / count(v) > 20 THEN 9.0 ELSE any_value(c) END AS v FROM w GROUP BY y, x"))(lambda s, d: O.focal_threshold(X.grid(s, d, band="b2"), N, N, [9, 5], [20, 20]))
query("o113_majority_priors", X.sql(X.PIXELS, _B2, _window(3), "m AS (SELECT y, x, v AS k, sum(CASE WHEN v = 1 THEN 3.0 WHEN v IN (2, 3, 4) THEN 1.0 ELSE 0.0 END) AS n, max(CAST(v = c AS INTEGER)) AS own FROM w GROUP BY y, x, v)", "SELECT y, x, arg_max(k, row(n, own, -k)) AS v FROM m GROUP BY y, x"))(
    lambda s, d: O.focal_mode(X.grid(s, d, band="b2"), N, N, priors={1.0: 3.0, 2.0: 1.0, 3.0: 1.0, 4.0: 1.0})
)
query("o114_class_prior", X.sql(X.PIXELS, _B2, _window(3), "e AS (SELECT y, x, exp(-0.5::DOUBLE * count_if((di <> 0 OR dj <> 0) AND v = 2)) AS a, exp(-0.5::DOUBLE * count_if((di <> 0 OR dj <> 0) AND v = 1)) AS b FROM w GROUP BY y, x)", "SELECT y, x, round(a / (a + b), 6) AS p0, round(b / (a + b), 6) AS p1 FROM e"))(
    lambda s, d: O.class_prior(X.grid(s, d, band="b2"), N, N, [1.0, 2.0], 0.5).select("y", "x", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))
)

query("o114_class_prior_four", X.sql(X.PIXELS, _B2, _window(3), "e AS (SELECT y, x, count(*) FILTER (WHERE v = 1) AS a, count(*) FILTER (WHERE v = 2) AS b, count(*) FILTER (WHERE v = 3) AS c FROM (SELECT * FROM w WHERE (di = 0) <> (dj = 0) UNION ALL SELECT y, x, c, NULL, 0, 0 FROM g, (SELECT NULL AS c)) GROUP BY y, x)",
    "p AS (SELECT y, x, exp(-(0.2::DOUBLE * b + 0.4::DOUBLE * c)) AS p, exp(-(0.6::DOUBLE * a + 0.1::DOUBLE * c)) AS q, exp(-(0.3::DOUBLE * a + 0.5::DOUBLE * b)) AS r FROM e)", "SELECT y, x, round(p / (p + q + r), 6) AS p0, round(q / (p + q + r), 6) AS p1, round(r / (p + q + r), 6) AS p2 FROM p"))(
    lambda s, d: O.class_prior(X.grid(s, d, band="b2"), N, N, [1.0, 2.0, 3.0], [[0.0, 0.2, 0.4], [0.6, 0.0, 0.1], [0.3, 0.5, 0.0]], eight=False).select("y", "x", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(3)])
)


def _mixed_grid(s, d):
    v = F.when(F.col("v") < 3, 11.0).when(F.col("v") < 5, 12.0).when(F.col("v") < 6, 13.0).when(F.col("v") < 9, 20.0).otherwise(30.0)
    return X.grid(s, d, band="b2").withColumn("v", v)


query("o106_focal_mixed", X.sql(X.PIXELS, "g AS (SELECT y, x, CASE WHEN b2 < 3 THEN 11.0 WHEN b2 < 5 THEN 12.0 WHEN b2 < 6 THEN 13.0 WHEN b2 < 9 THEN 20.0 ELSE 30.0 END AS v FROM px WHERE scene = 1)", _window(3),
    "n AS (SELECT y, x, count_if(v = 11) AS a, count_if(v = 12) AS b, count_if(v = 13) AS m, count_if(v = 20) AS nf, count_if(v = 30) AS w FROM w GROUP BY y, x)",
    "SELECT y, x, CAST(CASE WHEN a + b + m > 0 AND a + b + m >= nf + w THEN CASE WHEN a / nullif(a + b, 0) >= 0.75 THEN 11 WHEN b / nullif(a + b, 0) >= 0.75 THEN 12 ELSE 13 END WHEN w > 0 AND w >= nf THEN 30 ELSE 20 END AS DOUBLE) AS v FROM n"))(
    lambda s, d: O.focal_mixed(_mixed_grid(s, d), N, N)
)
_GN = "g AS (SELECT y, x, CASE WHEN b2 = 3 THEN NULL ELSE b0 END AS v FROM px WHERE scene = 1)"


def _gaps(s, d):
    return X.pixels(s, d).where("scene = 1").select("y", "x", F.when(F.col("b2") != 3, F.col("b0")).alias("v"))


query("o110_smooth_nodata", X.sql(X.PIXELS, _GN, _window(3), "SELECT y, x, round(coalesce(any_value(c), avg(v)), 6) AS v FROM w GROUP BY y, x"))(lambda s, d: O.focal(_gaps(s, d), "smoothnodata", N, N).select("y", "x", F.round("v", 6).alias("v")))
query("o105_focal_scramble")(lambda s, d: O.focal(X.grid(s, d), "scramble", N, N))
_OPEN = ["e AS (SELECT y, x, min(v) AS v FROM w GROUP BY y, x)", _window(3, "e", "w2"), "SELECT y, x, max(v) AS v FROM w2 GROUP BY y, x"]
query("o112_open", X.sql(X.PIXELS, X.GRID, _window(3), *_OPEN))(lambda s, d: O.opened(X.grid(s, d), N, N))
query("o112_close", X.sql(X.PIXELS, X.GRID, _window(3), *[p.replace("min(v)", "#").replace("max(v)", "min(v)").replace("#", "max(v)") for p in _OPEN]))(lambda s, d: O.closed(X.grid(s, d), N, N))
query("o121_erode_if", X.sql(X.PIXELS, X.GRID, _window(3), "SELECT y, x, CASE WHEN any_value(c) - min(v) > 10 THEN min(v) ELSE any_value(c) END AS v, CAST(any_value(c) - min(v) > 10 AS INTEGER) AS changed FROM w GROUP BY y, x"))(lambda s, d: O.morphology_if(X.grid(s, d), "erode", N, N, 3, 10.0))
query("o093_focal_down", X.sql(X.PIXELS, X.GRID, _window(3), "SELECT y, x, sum(v) AS v FROM w WHERE (y + 2) % 3 = 0 AND (x + 2) % 3 = 0 GROUP BY y, x"))(lambda s, d: O.focal(X.grid(s, d), "sum", N, N, down=3))
query("o115_shift", X.sql(X.PIXELS, X.GRID, "SELECT CAST(y + 2 AS INTEGER) AS y, CAST(x - 1 AS INTEGER) AS x, v FROM g"))(lambda s, d: O.shift(X.grid(s, d), 2, -1))
query("o115_shift_bilinear", X.sql(X.PIXELS, X.GRID, "SELECT a.y, a.x, round(0.5 * a.v + 0.5 * b.v, 6) AS v FROM g a JOIN g b ON b.y = a.y - 1 AND b.x = a.x"))(lambda s, d: O.shift(X.grid(s, d), 0.5, 0, True).select("y", "x", F.round("v", 6).alias("v")))
query("o118_shadow", X.sql(X.PIXELS, X.GRID, "t AS (SELECT a.y, a.x, max(b.v - k.d) AS top FROM g a, range(1, 32) k(d), g b WHERE b.x = a.x AND b.y = a.y - k.d AND k.d < floor(abs(b.v) + 1e-9) GROUP BY 1, 2)", "SELECT g.y, g.x, CASE WHEN t.top > g.v THEN 1 ELSE 0 END AS shadow FROM g LEFT JOIN t ON g.y = t.y AND g.x = t.x"))(
    lambda s, d: O.shadow(X.grid(s, d), 45.0, 0.0)
)
query("o116_wavelet2d")(lambda s, d: O.per_tile(X.pixels(s, d).select("scene", "y", "x", F.col("b0").alias("v")), O.haar2d))
query("o116_wavelet2d_cut")(lambda s, d: O.per_tile(X.pixels(s, d).select("scene", "y", "x", F.col("b0").alias("v")), lambda a: O.wavelet_cut(a, 50)))
for _i, _n in enumerate(("longest", "longest_angle", "shortest", "shortest_angle")):
    query(f"o117_line_{_n}")(lambda s, d, i=_i: O.per_tile(X.pixels(s, d).select("scene", "y", "x", F.col("b2").alias("v")), lambda a, i=i: O.linear_features(a, 15.0, 12.0, 1.0)[i]))
query("o119_ground_pass")(lambda s, d: O.per_tile(X.pixels(s, d).select("scene", "y", "x", F.col("b0").alias("v")), lambda a: O.ground_pass(a, 5.0, 2, 3, "senw") * 1.0))
query("o120_dem_vito")(lambda s, d: O.per_tile(X.pixels(s, d).select("scene", "y", "x", F.col("b0").alias("v")), lambda a: O.ground_mask(a, (20.0, 10.0, 5.0, 1.0))))
_EROSION = "e AS (SELECT y, x, CASE WHEN any_value(c) - min(v) > {h} THEN min(v) ELSE any_value(c) END AS v FROM {w} GROUP BY y, x)"
query("o120_dem_open", X.sql(X.PIXELS, X.GRID, _window(3), _EROSION.format(h=2, w="w"), _window(3, "e", "w2"), "SELECT y, x, CASE WHEN max(v) - any_value(c) > 2 THEN max(v) ELSE any_value(c) END AS v FROM w2 GROUP BY y, x"))(lambda s, d: O.dem_filter(X.grid(s, d), "open", N, N, rise=2.0))
query("o120_dem_etew_min", X.sql(X.PIXELS, X.GRID, _window(3), _EROSION.format(h=6, w="w"), _window(5, "e", "w2"), "SELECT y, x, CASE WHEN any_value(c) - min(v) > 10 THEN min(v) ELSE any_value(c) END AS v FROM w2 GROUP BY y, x"))(lambda s, d: O.dem_filter(X.grid(s, d), "etew_min", N, N, largest=5, slope=2.0))
query("o120_dem_promorph", X.sql(X.PIXELS, X.GRID, _window(3), _EROSION.format(h=4, w="w"), _window(3, "e", "w2"), "f AS (SELECT y, x, CASE WHEN max(v) - any_value(c) > 4 THEN max(v) ELSE any_value(c) END AS v FROM w2 GROUP BY y, x)", _window(3, "f", "w3"), "SELECT y, x, median(v) AS v FROM w3 GROUP BY y, x"))(lambda s, d: O.dem_filter(X.grid(s, d), "promorph", N, N, largest=3, rise=4.0, slope=1.0))
query("o120_dem_promorph_rounds")(lambda s, d: O.dem_filter(X.grid(s, d), "promorph", N, N, largest=9, rise=1.0, slope=1.0, top=6.0))
