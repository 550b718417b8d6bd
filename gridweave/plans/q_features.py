"""Points and polygons on grids, sampling, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy as A
from ..operators import sample as M
from ..operators import zonal as Z
from ..registry import query
from . import fixtures as X

N = X.SIDE
BASE = (X.PIXELS, X.GRID)
_ZJ = "z AS (SELECT zc.fid, g.v FROM zc JOIN g USING (y, x))"


def _cells(s, d):
    return Z.cells_of(X.zones(s, d), N, N)


def _r(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes])


query("o043_point_lookup", X.sql(*BASE, X.POINTS, "SELECT id, g.v FROM pt JOIN g ON g.y = floor(pt.y) AND g.x = floor(pt.x)"))(lambda s, d: Z.sample_points(X.points(s, d), X.grid(s, d), ["v"]).select("id", "v"))
query("o014_add_data", X.sql(X.PIXELS, X.POINTS, "SELECT id, z, b0, b1, b2 FROM pt JOIN px ON px.y = floor(pt.y) AND px.x = floor(pt.x) AND scene = 2"))(lambda s, d: Z.sample_points(X.points(s, d), X.pixels(s, d).where("scene = 2"), ["b0", "b1", "b2"]).select("id", "z", "b0", "b1", "b2"))
query("o044_buffered_points", X.sql(*BASE, X.POINTS, "SELECT id, round(avg(g.v), 6) AS mean, count(g.v) AS count FROM pt JOIN g ON abs(g.y - floor(pt.y)) <= 1 AND abs(g.x - floor(pt.x)) <= 1 GROUP BY id"))(lambda s, d: _r(Z.zonal(Z.point_cells(X.points(s, d), 1), X.grid(s, d), ["mean", "count"], "id")))
query("o044_buffered_points_disc", X.sql(*BASE, X.POINTS, "SELECT id, max(g.v) AS max FROM pt JOIN g ON pow(g.y - floor(pt.y), 2) + pow(g.x - floor(pt.x), 2) <= 4 GROUP BY id"))(lambda s, d: Z.zonal(Z.point_cells(X.points(s, d), 2, True), X.grid(s, d), ["max"], "id"))
query("o045_cells_in_polygons", X.sql(X.ZONES, "SELECT fid, y, x FROM zc"))(_cells)
query("o046_rasterize", X.sql(X.ZONES, "SELECT y, x, arg_max(fid * 10, fid) AS v FROM zc GROUP BY y, x"))(lambda s, d: Z.rasterize(_cells(s, d), X.zones(s, d).select("fid", (F.col("fid") * 10).alias("value"))))
query("o046_rasterize_touched", X.sql(X.ZONES, """tc AS (SELECT fid, CAST(cy AS INTEGER) AS y, CAST(cx AS INTEGER) AS x FROM zn, range(0, 32) a(cx), range(0, 32) b(cy)
  WHERE cx + 1 > x0 AND cy + 1 > y0 AND CASE WHEN fid % 2 = 0 THEN cx < x0 + 6 AND cy < y0 + 6 ELSE (cx - x0) + (cy - y0) < 7.3 END)""", "SELECT fid, y, x FROM tc"))(lambda s, d: Z.cells_of(X.zones(s, d), N, N, touched=True))
query("o077_zonal_stats", X.sql(*BASE, X.ZONES, _ZJ, "SELECT fid, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev, median(v) AS median, min(v) AS min, max(v) AS max, sum(v) AS sum, count(v) AS count, round(quantile_cont(v, 0.95), 6) AS percentile FROM z GROUP BY fid"))(
    lambda s, d: _r(Z.zonal(_cells(s, d), X.grid(s, d), ["mean", "stdev", "median", "min", "max", "sum", "count", "percentile"]))
)
query("o077_all_points", X.sql(*BASE, X.ZONES, "SELECT zc.fid, zc.y, zc.x, g.v FROM zc JOIN g USING (y, x)"))(lambda s, d: Z.all_points(_cells(s, d), X.grid(s, d)).select("fid", "y", "x", "v"))
query("o077_centroid", X.sql(*BASE, X.ZONES, "k AS (SELECT fid, CASE WHEN fid % 2 = 0 THEN y0 + 3 ELSE y0 + 7.3 / 3 END AS cy, CASE WHEN fid % 2 = 0 THEN x0 + 3 ELSE x0 + 7.3 / 3 END AS cx FROM zn)", "SELECT fid, g.v FROM k JOIN g ON g.y = floor(cy) AND g.x = floor(cx)"))(
    lambda s, d: Z.centroid_cells(X.zones(s, d)).join(X.grid(s, d), ["y", "x"]).select("fid", "v")
)
query("o078_zonal_mode", X.sql(X.PIXELS, X.GRID.replace("b0", "b2"), X.ZONES, _ZJ, "n AS (SELECT fid, v, count(*) AS n FROM z GROUP BY fid, v)", "SELECT fid, arg_max(v, row(n, -v)) AS mode, CAST(sum(CASE WHEN v = 1 THEN n ELSE 0 END) AS BIGINT) AS count1, round(sum(CASE WHEN v = 1 THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 6) AS proportion1 FROM n GROUP BY fid"))(
    lambda s, d: _r(Z.zonal_class(_cells(s, d), X.grid(s, d, band="b2"), classes=[1]))
)
query("o079_grid_points", X.sql(X.POINTS, """SELECT CAST(floor(y) AS INTEGER) AS y, CAST(floor(x) AS INTEGER) AS x, arg_max(z, id) AS last, arg_min(z, id) AS first, min(z) AS min, max(z) AS max, round(avg(z), 6) AS mean, median(z) AS median, round(var_pop(z), 4) AS var,
  round(stddev_pop(z), 6) AS stdev, sum(z) AS sum, count(z) AS number FROM pt GROUP BY 1, 2"""))(
    lambda s, d: _r(Z.grid_points(X.points(s, d), ["last", "first", "min", "max", "mean", "median", "stdev", "sum", "number", "var"]).withColumn("var", F.round("var", 4)))
)
query("o079_grid_last_returns", X.sql(X.POINTS, "SELECT CAST(floor(y / 2) AS INTEGER) AS y, CAST(floor(x / 2) AS INTEGER) AS x, min(z) AS min, arg_min(z, row(abs(z), z)) AS absmin, round(quantile_cont(z, 0.95), 6) AS percentile FROM pt WHERE return_no = n_returns AND class IN (1, 2) GROUP BY 1, 2"))(
    lambda s, d: _r(Z.grid_points(X.points(s, d), ["min", "absmin", "percentile"], dx=2.0, dy=2.0, returns="last", classes=[1, 2]))
)
query("o079_grid_profile", X.sql(X.POINTS, "SELECT CAST(floor(y / 4) AS INTEGER) AS y, CAST(floor(x / 4) AS INTEGER) AS x, CAST(row_number() OVER (PARTITION BY floor(y / 4), floor(x / 4) ORDER BY z) - 1 AS INTEGER) AS k, z FROM pt WHERE return_no = 1"))(
    lambda s, d: Z.grid_points(X.points(s, d), ["profile"], dx=4.0, dy=4.0, returns="first").select("y", "x", F.posexplode("profile").alias("k", "z"))
)

# --- sampling -----------------------------------------------------------------------------------------------------

_U = "CAST(CAST('0x' || substr(md5('1:' || {k}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE"
_UP = _U.format(k="y || ':' || x")
query("o133_top_k", X.sql(*BASE, "SELECT y, x, v FROM g ORDER BY v DESC, y, x LIMIT 25"))(lambda s, d: M.top(X.grid(s, d), 25, [F.desc("v"), F.col("y"), F.col("x")]))
query("o135_random_percent", X.sql(*BASE, f"SELECT y, x, v FROM g WHERE {_UP} < 0.3::DOUBLE"))(lambda s, d: M.percent(X.grid(s, d), ["y", "x"], 30))
query("o135_at_most_by_class", X.sql(X.CLASSMAPS, f"r AS (SELECT y, x, ref, row_number() OVER (PARTITION BY ref ORDER BY {_UP}, y, x) AS k FROM cm)", "SELECT y, x, ref FROM r WHERE k <= 7"))(lambda s, d: M.at_most(X.classmaps(s, d).select("y", "x", "ref"), "ref", ["y", "x"], 7))
query("o136_at_most_by_polygon", X.sql(X.ZONES, f"r AS (SELECT fid, y, x, row_number() OVER (PARTITION BY fid ORDER BY {_UP}, y, x) AS k FROM zc)", "SELECT fid, y, x FROM r WHERE k <= 5"))(lambda s, d: M.at_most(_cells(s, d), "fid", ["y", "x"], 5))
query("o137_grid_points", "SELECT i AS id, CAST((i // 7) * 5 AS INTEGER) AS y, CAST((i % 7) * 5 AS INTEGER) AS x FROM range(49) t(i)")(lambda s, d: M.grid_points(s, 32, 32, 5))
_ID = lambda seed: _U.replace("'1:'", f"'{seed}:'").format(k="i")
query("o137_random_points", f"SELECT i AS id, round({_ID(1)} * 32, 6) AS y, round({_ID(2)} * 32, 6) AS x FROM range(200) t(i)")(lambda s, d: _r(M.random_points(s, 200, 32.0, 32.0)))
query("o138_down_sample", X.sql(*BASE, "SELECT y, x, v FROM g WHERE y % 4 = 0 AND x % 4 = 0"))(lambda s, d: M.thinned(X.grid(s, d), 4))
query("o139_balance", X.sql(X.CLASSMAPS, f"r AS (SELECT y, x, ref, row_number() OVER (PARTITION BY ref ORDER BY {_UP}, y, x) AS k FROM cm)", "s AS (SELECT y, x, ref, row_number() OVER (PARTITION BY ref ORDER BY y, x) - 1 AS r, count(*) OVER (PARTITION BY ref) AS n FROM r WHERE k <= 60)",
    "SELECT y, x, ref, CAST(c AS INTEGER) AS copy FROM s, range(0, 60) t(c) WHERE c * n + r < 60"))(lambda s, d: M.balanced(X.classmaps(s, d).select("y", "x", "ref"), "ref", ["y", "x"], 60))

# --- accuracy -----------------------------------------------------------------------------------------------------

_M = "m AS (SELECT ref, cls, CAST(count(*) AS DOUBLE) AS n FROM cm GROUP BY 1, 2)"
_BC = "k AS (SELECT coalesce(a.ref, b.cls) AS class, coalesce(n_ref, 0) AS n_ref, coalesce(n_cls, 0) AS n_cls, coalesce(hit, 0) AS hit FROM (SELECT ref, sum(n) AS n_ref, sum(CASE WHEN ref = cls THEN n ELSE 0 END) AS hit FROM m GROUP BY ref) a FULL JOIN (SELECT cls, sum(n) AS n_cls FROM m GROUP BY cls) b ON a.ref = b.cls)"
query("o080_confusion", X.sql(X.CLASSMAPS, _M, "SELECT * FROM m"))(lambda s, d: A.confusion(X.classmaps(s, d), "ref", "cls"))
query("o080_accuracy_by_class", X.sql(X.CLASSMAPS, _M, _BC, "SELECT class, n_ref, n_cls, hit, round(hit / n_ref * 100, 6) AS pa, round(sqrt(hit / n_ref * (1 - hit / n_ref) / n_ref) * 100, 6) AS pa_se, round(hit / n_cls * 100, 6) AS ua, round(sqrt(hit / n_cls * (1 - hit / n_cls) / n_cls) * 100, 6) AS ua_se FROM k"))(
    lambda s, d: _r(A.by_class(A.confusion(X.classmaps(s, d), "ref", "cls")))
)
query("o080_kappa", X.sql(X.CLASSMAPS, _M, _BC, "t AS (SELECT sum(n_ref) AS n, sum(hit) / sum(n_ref) AS po, sum(n_ref * n_cls) / (sum(n_ref) * sum(n_ref)) AS pe FROM k)", "SELECT n, round(po * 100, 6) AS oa, round(sqrt(po * (1 - po) / n) * 100, 6) AS oa_se, round((po - pe) / (1 - pe), 6) AS kappa FROM t"))(
    lambda s, d: _r(A.overall(A.confusion(X.classmaps(s, d), "ref", "cls")))
)
query("o134_sorted_classes", X.sql(X.CLASSMAPS, "SELECT DISTINCT ref AS class FROM cm ORDER BY 1"))(lambda s, d: X.classmaps(s, d).select(F.col("ref").alias("class")).distinct().orderBy("class"))
_DIFF = "f AS (SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, CASE WHEN a.b2 = b.b2 THEN 0 WHEN a.b2 > b.b2 THEN 1 WHEN a.b2 < b.b2 THEN 2 END AS flag FROM (SELECT * FROM px WHERE scene = 1) a FULL JOIN (SELECT * FROM px WHERE scene = 2) b ON a.y = b.y AND a.x = b.x)"
_two = lambda s, d: (X.grid(s, d, 1, "b2"), X.grid(s, d, 2, "b2"))
query("o142_difference", X.sql(X.PIXELS, _DIFF, "SELECT * FROM f"))(lambda s, d: A.difference(*_two(s, d)))
query("o142_identical", X.sql(X.PIXELS, _DIFF, "SELECT count(*) AS n, count_if(flag IS NULL OR flag > 0) AS n_different FROM f"))(lambda s, d: A.identical(*_two(s, d)))
query("o149_diff_confusion", X.sql(X.PIXELS, "SELECT a.b2 AS ref, b.b2 AS cls, CAST(count(*) AS DOUBLE) AS n FROM px a JOIN px b ON a.y = b.y AND a.x = b.x WHERE a.scene = 1 AND b.scene = 2 GROUP BY 1, 2"))(
    lambda s, d: A.confusion(X.grid(s, d, 1, "b2").withColumnRenamed("v", "p").join(X.grid(s, d, 2, "b2").withColumnRenamed("v", "q"), ["y", "x"]), "p", "q")
)
query("o147_extract_samples", X.sql(X.PIXELS, "SELECT a.y, a.x, a.b2 AS v, b.b0, b.b1 FROM px a JOIN px b ON a.y = b.y AND a.x = b.x WHERE a.scene = 1 AND b.scene = 2 AND a.b2 IN (1, 2)"))(
    lambda s, d: A.extract_samples(X.grid(s, d, 1, "b2"), X.pixels(s, d).where("scene = 2").select("y", "x", "b0", "b1"), [1.0, 2.0])
)
_V = "w AS (SELECT pt.id, any_value(pt.class) AS ref, g.v AS k, count(*) AS n FROM pt JOIN g ON abs(g.y - floor(pt.y)) <= 1 AND abs(g.x - floor(pt.x)) <= 1 GROUP BY pt.id, g.v)"
query("o148_validate", X.sql(X.PIXELS, X.GRID.replace("b0", "b2"), X.POINTS, _V, "SELECT id, any_value(ref) AS ref, arg_max(k, row(n, -k)) AS cls FROM w GROUP BY id"))(lambda s, d: A.validate(X.points(s, d), X.grid(s, d, band="b2"), "class", 3))
query("o148_validate_homogeneous", X.sql(X.PIXELS, X.GRID.replace("b0", "b2"), X.POINTS, _V, "SELECT id, any_value(ref) AS ref, any_value(k) AS cls FROM w GROUP BY id HAVING count(*) = 1"))(lambda s, d: A.validate(X.points(s, d), X.grid(s, d, band="b2"), "class", 3, True))
