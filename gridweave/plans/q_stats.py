"""Global statistics, histograms, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..registry import query
from . import fixtures as X

PX, G = X.PIXELS, X.GRID


def _r(df, n=6, skip=()):
    return df.select(*[c if c in skip or t not in ("double", "float") else F.round(c, n).alias(c) for c, t in df.dtypes])


query("o050_describe", X.sql(PX, G, """SELECT count(v) AS nvalid, count_if(v IS NULL) AS ninvalid, min(v) AS min, max(v) AS max, arg_min(v, row(abs(v), v)) AS absmin, arg_max(v, row(abs(v), v)) AS absmax, sum(v) AS sum, round(avg(v), 6) AS mean,
  median(v) AS median, round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS stdev, round((avg(v*v*v) - 3 * avg(v) * avg(v*v) + 2 * avg(v) ** 3) / stddev_pop(v) ** 3, 6) AS skewness,
  round((avg(v*v*v*v) - 4 * avg(v) * avg(v*v*v) + 6 * avg(v) ** 2 * avg(v*v) - 3 * avg(v) ** 4) / var_pop(v) ** 2 - 3, 6) AS kurtosis, round(avg(v*v*v), 4) AS moment3, round(avg(v*v*v*v), 2) AS moment4 FROM g"""))(
    lambda s, d: _r(S.describe(X.grid(s, d)), skip=("moment3", "moment4")).withColumns({"moment3": F.round("moment3", 4), "moment4": F.round("moment4", 2)})
)
query("o052_minmax_constrained", X.sql(PX, G, "SELECT min(v) AS min, max(v) AS max FROM g WHERE v BETWEEN 10 AND 40"))(lambda s, d: X.grid(s, d).select(S.masked_valid(F.col("v"), 10, 40).alias("v")).agg(F.min("v").alias("min"), F.max("v").alias("max")))
query("o053_sum_mean_by_scene", X.sql(PX, "SELECT scene, sum(b0) AS sum, round(avg(b0), 6) AS mean, count(b0) AS nvalid FROM px GROUP BY scene"))(lambda s, d: X.pixels(s, d).groupBy("scene").agg(F.sum("b0").alias("sum"), F.round(F.avg("b0"), 6).alias("mean"), F.count("b0").alias("nvalid")))
query("o055_erase_nodata", X.sql(PX, "SELECT scene, y, x, b2 AS v FROM px WHERE b2 NOT IN (0, 10)"))(lambda s, d: X.pixels(s, d).select("scene", "y", "x", F.col("b2").alias("v")).where(~F.col("v").isin(0, 10)))
query("o058_central_moment", X.sql(PX, G, "m AS (SELECT avg(v) AS m FROM g)", "SELECT round(avg((v - m) ** 3), 4) AS central FROM g, m"))(lambda s, d: _r(S.central_moment(X.grid(s, d), 3), 4))
query("o060_percentile", X.sql(PX, G, "SELECT round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM g"))(lambda s, d: _r(S.percentile(X.grid(s, d), [5, 50, 95])))
query("o061_percentiles_by_bin", X.sql(PX, "n AS (SELECT b1 AS v, row_number() OVER (ORDER BY b1) - 1 AS r, count(*) OVER () // 7 AS size FROM px)", "SELECT CAST(r // size AS INTEGER) AS bin, max(v) AS v FROM n WHERE r // size < 7 GROUP BY 1"))(lambda s, d: S.equal_count_maxima(X.pixels(s, d), 7, "b1"))
_H = "SELECT b.bin, count(h.v) AS n FROM (SELECT unnest(range(k)) AS bin FROM r) b LEFT JOIN (SELECT v, CAST(floor((v - lo) * (k - 1) / (hi - lo)) AS BIGINT) AS bin FROM g, r) h ON h.bin = b.bin GROUP BY b.bin"
query("o062_distribution", X.sql(PX, G, "r AS (SELECT min(v) AS lo, max(v) AS hi, CAST(10 AS BIGINT) AS k FROM g)", _H))(lambda s, d: S.histogram(X.grid(s, d), 10))
query("o062_kernel_density", X.sql(PX, G, "r AS (SELECT min(v) AS lo, max(v) AS hi, count(v) AS n, 1.06::DOUBLE * stddev_pop(v) * pow(count(v), -0.2::DOUBLE) AS s FROM g)", """SELECT CAST(b.bin AS INTEGER) AS bin, round(any_value(lo + (hi - lo) * b.bin / 15), 6) AS x,
  round(sum(exp(-0.5::DOUBLE * pow((v - (lo + (hi - lo) * b.bin / 15)) / s, 2)) / (s * sqrt(2 * pi()))) / any_value(n), 6) AS density FROM g, r, range(16) b(bin) GROUP BY b.bin"""))(lambda s, d: _r(S.kernel_density(X.grid(s, d), 16)))
query("o063_distribution2d", X.sql(PX, "r AS (SELECT min(b0) AS a0, max(b0) AS a1, min(b1) AS c0, max(b1) AS c1 FROM px)", "SELECT CAST(least(7, floor((b0 - a0) * 8 / (a1 - a0))) AS INTEGER) AS bx, CAST(least(7, floor((b1 - c0) * 8 / (c1 - c0))) AS INTEGER) AS by, count(*) AS n FROM px, r GROUP BY 1, 2"))(lambda s, d: S.histogram2d(X.pixels(s, d), "b0", "b1", 8))
query("o064_histogram_unit_bins", X.sql(PX, "g AS (SELECT b1 AS v FROM px)", "r AS (SELECT min(v) AS lo, max(v) AS hi, CAST(max(v) - min(v) + 1 AS BIGINT) AS k FROM g)", _H))(lambda s, d: S.histogram(X.pixels(s, d).select(F.col("b1").alias("v")), 0))
query("o064_histogram_256", X.sql(PX, "g AS (SELECT b1 AS v FROM px)", "r AS (SELECT min(v) AS lo, max(v) AS hi, CAST(256 AS BIGINT) AS k FROM g)", _H))(lambda s, d: S.histogram(X.pixels(s, d).select(F.col("b1").alias("v")), 256))
query("o065_extremes_with_position", X.sql(PX, G, "a AS (SELECT * FROM g ORDER BY v, y, x LIMIT 1)", "b AS (SELECT * FROM g ORDER BY v DESC, y, x LIMIT 1)", "SELECT a.v AS min, a.y AS min_y, a.x AS min_x, b.v AS max, b.y AS max_y, b.x AS max_x FROM a, b"))(lambda s, d: S.extremes(X.grid(s, d)))
query("o066_distinct_values", X.sql(PX, G, "SELECT DISTINCT CAST(v AS INTEGER) AS v FROM g"))(lambda s, d: S.distinct_values(X.grid(s, d)))
query("o067_reference_pixel", X.sql(PX, G, "SELECT CAST(floor(sum(x + 1) / count(*) - 0.5::DOUBLE) AS DOUBLE) AS ref_x, 32.0::DOUBLE - (ceil(sum(y + 1) / count(*) - 0.5::DOUBLE - 1) + 1) AS ref_y FROM g"))(lambda s, d: S.reference_pixel(X.grid(s, d), 0.0, 32.0))
query("o067_reference_pixel_no_position", X.sql(PX, G, "SELECT CAST(floor(sum(x + 1) / count(*) - 0.5::DOUBLE) AS DOUBLE) AS ref_x, CAST(floor(sum(y + 1) / count(*) - 0.5::DOUBLE) + 1 AS DOUBLE) AS ref_y FROM g"))(lambda s, d: S.reference_pixel(X.grid(s, d)))
query("o068_rmse", X.sql(PX, "SELECT round(sqrt(avg((b0 - b1) ** 2)), 6) AS rmse, round(sqrt(avg((b0 - b1) ** 2)) / (max(b1) - min(b1)), 6) AS nrmse, round(sqrt(avg((b0 - b1) ** 2)) / avg(b1), 6) AS cvrmse FROM px"))(lambda s, d: _r(S.errors(X.pixels(s, d), "b0", "b1")))
query("o069_covariance", X.sql(PX, "SELECT round(covar_samp(b0, b1), 6) AS cov, round(corr(b0, b1), 6) AS corr FROM px"))(lambda s, d: _r(S.covariance(X.pixels(s, d), "b0", "b1")))
query("o069_cross_correlation", X.sql(X.SERIES, "p AS (SELECT pixel, t, v AS a, v * 2 + t % 2 AS b FROM se)", "m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n FROM p)",
    "SELECT CAST(l.lag AS INTEGER) AS lag, round(sum((p.a - ma) * (q.b - mb)) / (any_value(n) - 1) / (any_value(sa) * any_value(sb)), 6) AS r FROM range(-3, 3) l(lag), p, p q, m WHERE p.pixel = q.pixel AND q.t = p.t + l.lag GROUP BY 1"))(
    lambda s, d: _r(S.cross_correlation(X.series(s, d).select("pixel", "t", F.col("v").alias("a"), (F.col("v") * 2 + F.col("t") % 2).alias("b")), "pixel", "t", "a", "b", 3))
)
query("o070_linear_regression", X.sql(PX, "SELECT round(regr_intercept(b1, b0), 6) AS c0, round(regr_slope(b1, b0), 6) AS c1, round(regr_r2(b1, b0), 6) AS r2, round(sqrt(regr_syy(b1, b0) * (1 - regr_r2(b1, b0)) / count(*)), 6) AS rmse, count(*) AS n FROM px"))(lambda s, d: _r(S.regression(X.pixels(s, d), "b0", "b1")))
_TWO = "ab AS (SELECT a.b0 AS p, b.b0 AS q FROM px a JOIN px b ON a.y = b.y AND a.x = b.x WHERE a.scene = 1 AND b.scene = 2)"


def _two(s, d):
    px = X.pixels(s, d)
    return px.where("scene = 1").select("y", "x", F.col("b0").alias("p")).join(px.where("scene = 2").select("y", "x", F.col("b0").alias("q")), ["y", "x"])


query("o071_image_regression", X.sql(PX, _TWO, "SELECT round(regr_intercept(q, p), 6) AS c0, round(regr_slope(q, p), 6) AS c1, round(regr_r2(q, p), 6) AS r2, round(sqrt(regr_syy(q, p) * (1 - regr_r2(q, p)) / count(*)), 6) AS rmse, count(*) AS n FROM ab"))(lambda s, d: _r(S.regression(_two(s, d), "p", "q")))
query("o071_perpendicular_regression", X.sql(PX, _TWO, "SELECT round(sign(corr(p, q)) * var_pop(q) / var_pop(p), 6) AS c1, round(avg(q) - sign(corr(p, q)) * var_pop(q) / var_pop(p) * avg(p), 6) AS c0, round(corr(p, q) ** 2, 6) AS r2 FROM ab"))(lambda s, d: _r(S.perpendicular_regression(_two(s, d), "p", "q")))
query("o072_normalize_percent", X.sql(PX, G, "SELECT y, x, round(v * 100 / sum(v) OVER (), 6) AS v FROM g"))(lambda s, d: _r(S.normalized(X.grid(s, d), percent=True).select("y", "x", "v")))
query("o073_signature", X.sql(PX, "SELECT round(avg(b1), 6) AS k, round(avg(b1) ** 2 / var_pop(b1), 6) AS alpha, round(var_pop(b1) / avg(b1), 6) AS beta FROM px"))(lambda s, d: _r(S.signature(X.pixels(s, d), "b1")))
query("o074_stats_by_band", X.sql(PX, X.LONG, "SELECT band, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stdev FROM pl GROUP BY band"))(
    lambda s, d: _r(X.long(X.pixels(s, d)).groupBy("band").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev")))
)
query("o076_field_stats", "SELECT p_brand AS grp, count(*) AS n, min(p_size) AS min, max(p_size) AS max, round(avg(p_size), 6) AS mean, median(p_size) AS median FROM part GROUP BY p_brand")(
    lambda s, d: _r(X.table(s, d, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n"), F.min("p_size").alias("min"), F.max("p_size").alias("max"), F.avg("p_size").alias("mean"), F.median("p_size").alias("median")))
)
query("o081_rollup", X.sql(PX, "SELECT scene, y, count(*) AS n, sum(b0) AS s FROM px GROUP BY ROLLUP (scene, y)"))(lambda s, d: X.pixels(s, d).rollup("scene", "y").agg(F.count("*").alias("n"), F.sum("b0").alias("s")))
query("o081_cube", X.sql(PX, "SELECT scene, b2, count(*) AS n FROM px GROUP BY CUBE (scene, b2)"))(lambda s, d: X.pixels(s, d).cube("scene", "b2").agg(F.count("*").alias("n")))
_ONE = {
    "o051_abs_extremes": ("arg_min(v, row(abs(v), v)) AS absmin, arg_max(v, row(abs(v), v)) AS absmax", ["absmin", "absmax"]), "o054_mean": ("round(avg(v), 6) AS mean", ["mean"]), "o056_median": ("median(v) AS median", ["median"]),
    "o057_variance": ("round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS stdev", ["var", "stdev"]),
    "o059_skewness": ("round((avg(v*v*v) - 3 * avg(v) * avg(v*v) + 2 * avg(v) ** 3) / stddev_pop(v) ** 3, 6) AS skewness", ["skewness"]),
}
for _name, (_sql, _cols) in _ONE.items():
    query(_name, X.sql(PX, G, f"SELECT {_sql} FROM g"))(lambda s, d, c=_cols: _r(S.describe(X.grid(s, d)).select(*c)))
query("o075_column_stats", "SELECT l_returnflag AS grp, count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY 1")(
    lambda s, d: _r(X.table(s, d, "lineitem").where("l_linenumber between 2 and 5").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count("l_quantity").alias("n"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median")))
)
