"""Local map algebra and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import local as L
from ..registry import query
from . import fixtures as X

B = ["b0", "b1", "b2", "b3"]
PX = X.PIXELS


def _r(*cols: str, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


@query("o024_select_bands", X.sql(PX, "SELECT scene, y, x, b3 AS b0, b1 FROM px"))
def _(s, d):
    return L.select_bands(X.pixels(s, d), B, [3, *L.band_range(1, 1)], ["scene", "y", "x"])


@query("o025_scale_offset", X.sql(PX, "SELECT scene, y, x, b0 * 2.0 + 1 AS b0, b1 * 0.5 + 10 AS b1, b2 * 2.0 + 1 AS b2, b3 * 2.0 + 1 AS b3 FROM px"))
def _(s, d):
    return L.scale(X.pixels(s, d), B, [2.0, 0.5], [1.0, 10.0])


@query("o026_autoscale", X.sql(PX, "r AS (SELECT min(b0) AS a, max(b0) AS b FROM px)", "SELECT scene, y, x, round((b0 - a) * 255 / (b - a) + 0, 6) AS b0 FROM px, r"))
def _(s, d):
    return L.autoscale(X.pixels(s, d), ["b0"], 0.0, 255.0).select("scene", "y", "x", *_r("b0"))


@query("o027_get_mask_and", X.sql(PX, "SELECT scene, y, x, CASE WHEN b0 BETWEEN 10 AND 40 AND b2 BETWEEN 2 AND 8 THEN 1 ELSE 0 END AS m FROM px"))
def _(s, d):
    return X.pixels(s, d).select("scene", "y", "x", L.get_mask(None, ["b0", "b2"], [10, 2], [40, 8]).alias("m"))


@query("o027_get_mask_or", X.sql(PX, "SELECT scene, y, x, CASE WHEN b0 BETWEEN 0 AND 10 OR b1 BETWEEN 0 AND 10 THEN 1 ELSE 255 END AS m FROM px"))
def _(s, d):
    return X.pixels(s, d).select("scene", "y", "x", L.get_mask(None, ["b0", "b1"], [0], [10], "OR", 1, 255).alias("m"))


@query("o028_set_mask", X.sql(PX, """SELECT a.scene, a.y, a.x, CASE WHEN m.b2 = 3 THEN -1.0 WHEN m.b2 > 8 THEN -2.0 WHEN m.b2 < 1 THEN -3.0 ELSE a.b0 END AS b0
  FROM px a LEFT JOIN (SELECT y, x, b2 FROM px WHERE scene = 2) m ON a.y = m.y AND a.x = m.x"""))
def _(s, d):
    px = X.pixels(s, d)
    m = px.where("scene = 2").select("y", "x", "b2")
    return L.set_mask(px.select("scene", "y", "x", "b0"), ["b0"], m, [("=", 3, -1.0), (">", 8, -2.0), ("<", 1, -3.0)], ["y", "x"]).select("scene", "y", "x", "b0")


@query("o029_reclass_list", X.sql(PX, "SELECT scene, y, x, CASE b2 WHEN 1 THEN 100 WHEN 2 THEN 200 WHEN 3 THEN 300 ELSE b2 END AS b2 FROM px"))
def _(s, d):
    return L.reclass(X.pixels(s, d).select("scene", "y", "x", "b2"), "b2", {1.0: 100.0, 2.0: 200.0, 3.0: 300.0})


@query("o029_reclass_table", X.sql(PX, "SELECT scene, y, x, coalesce(t.n_regionkey * 10.0, b0) AS b0 FROM px LEFT JOIN nation t ON t.n_nationkey = b0"))
def _(s, d):
    t = X.table(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("source"), (F.col("n_regionkey") * 10.0).alias("target"))
    return L.reclass(X.pixels(s, d).select("scene", "y", "x", "b0"), "b0", t).select("scene", "y", "x", "b0")


@query("o030_threshold", X.sql(PX, "SELECT scene, y, x, CASE WHEN b0 BETWEEN 5 AND 45 THEN b0 END AS kept, CASE WHEN b0 BETWEEN 5 AND 45 THEN 1.0 ELSE b0 END AS flagged FROM px"))
def _(s, d):
    return X.pixels(s, d).select("scene", "y", "x", L.threshold(F.col("b0"), 5, 45).alias("kept"), L.threshold(F.col("b0"), 5, 45, 1.0).alias("flagged"))


@query("o033_nodata_counts", X.sql(PX, "SELECT scene, count_if(b2 <> 0 AND b2 <> 10) AS nvalid, count_if(b2 = 0 OR b2 = 10) AS ninvalid FROM px GROUP BY scene"))
def _(s, d):
    px = L.nullify(X.pixels(s, d), ["b2"], [0.0, 10.0])
    return px.groupBy("scene").agg(F.count("b2").alias("nvalid"), F.count_if(F.col("b2").isNull()).alias("ninvalid"))


@query("o035_class_names", X.sql(PX, "SELECT scene, y, x, n_name AS name FROM px JOIN nation ON n_nationkey = b0"))
def _(s, d):
    names = X.table(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("b0"), F.col("n_name").alias("name"))
    return X.pixels(s, d).join(names, "b0").select("scene", "y", "x", "name")


@query("o036_stretch_byte", X.sql(PX, "r AS (SELECT min(b1) AS a, max(b1) AS b FROM px)", "SELECT scene, y, x, least(255.0, greatest(0.0, floor((b1 - a) * 255.0::DOUBLE / (b - a)))) AS v FROM px, r"))
def _(s, d):
    px = X.pixels(s, d)
    r = px.agg(F.min("b1").alias("a"), F.max("b1").alias("b"))
    return px.join(F.broadcast(r)).select("scene", "y", "x", L.stretch_byte(F.col("b1"), F.col("a"), F.col("b")).alias("v"))


@query("o037_vegetation_indices", X.sql(PX, """SELECT scene, y, x, round((b1 - b0) / nullif(b1 + b0, 0), 6) AS ndvi, round((b1 - b0) * 1.16::DOUBLE / nullif(b1 + b0 + 0.16::DOUBLE, 0), 6) AS osavi,
  round((b2 - b0) / nullif(b2 + b0 - b3, 0), 6) AS vari, round(((b1 + 0.1::DOUBLE) - (b2 + 0.02::DOUBLE)) / ((b1 + 0.1::DOUBLE) + (b2 + 0.02::DOUBLE)), 6) AS gvmi FROM px"""))
def _(s, d):
    c = F.col
    return X.pixels(s, d).select("scene", "y", "x", F.round(L.index("ndvi", nir=c("b1"), red=c("b0")), 6).alias("ndvi"), F.round(L.index("osavi", nir=c("b1"), red=c("b0")), 6).alias("osavi"), F.round(L.index("vari", red=c("b0"), green=c("b2"), blue=c("b3")), 6).alias("vari"), F.round(L.index("gvmi", nir=c("b1"), swir=c("b2")), 6).alias("gvmi"))


@query("o038_histogram_match", X.sql(PX, "a AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS p FROM (SELECT b2 AS v, count(*) AS n FROM px WHERE scene = 1 GROUP BY 1))",
    "b AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS p FROM (SELECT b3 AS v, count(*) AS n FROM px WHERE scene = 2 GROUP BY 1))",
    "SELECT y, x, (SELECT min(b.v) FROM b WHERE b.p >= a.p) AS v FROM px JOIN a ON a.v = px.b2 WHERE scene = 1"))
def _(s, d):
    px = X.pixels(s, d)
    return L.histogram_match(px.where("scene = 1").select("y", "x", F.col("b2").alias("v")), px.where("scene = 2").select(F.col("b3").alias("v"))).select("y", "x", "v")


@query("o039_select_by_substring", "SELECT n_nationkey AS fid, n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS zone FROM nation WHERE contains(n_name, 'A')")
def _(s, d):
    t = X.table(s, d, "nation")
    return t.where(F.col("n_name").contains("A")).select(F.col("n_nationkey").alias("fid"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("zone"))


# --- composites ---------------------------------------------------------------------------------------------------

SEQ = "SELECT y, x, unnest(p) FROM ("


def _chosen(order: str) -> str:
    return X.sql(PX, f"SELECT y, x, arg_max(b0, k) AS b0, arg_max(b1, k) AS b1, arg_max(b2, k) AS b2, arg_max(b3, k) AS b3, count(*) AS n, arg_max(scene, k) AS seq FROM (SELECT *, {order} AS k FROM px) GROUP BY y, x")


_NDVI = "CASE WHEN b1 >= 0 AND b0 >= 0 AND b1 + b0 > 0 THEN (b1 - b0) / (b1 + b0) ELSE 0 END"
for _rule, _order in {"overwrite": "scene", "validband": "scene", "maxndvi": f"row({_NDVI}, scene)", "maxband": "row(b0, -scene)", "minband": "row(-b0, -scene)"}.items():
    query(f"o08{2 if _rule == 'overwrite' else 3 if _rule == 'maxndvi' else 4}_composite_{_rule}", _chosen(_order))(lambda s, d, rule=_rule: C.composite(X.pixels(s, d), B, rule))

for _rule, _f in {"mean": "round(avg({}), 6)", "median": "median({})", "sum": "sum({})", "stdev": "round(stddev_pop({}), 6)"}.items():
    query(f"o085_composite_{_rule}", X.sql(PX, "SELECT y, x, " + ", ".join(f"{_f.format(b)} AS {b}" for b in B) + ", count(*) AS n FROM px GROUP BY y, x"))(
        lambda s, d, rule=_rule: C.composite(X.pixels(s, d), B, rule).select("y", "x", *(_r(*B) if rule in ("mean", "stdev") else B), "n")
    )

query("o085_composite_weighted_mean", X.sql(PX, "SELECT y, x, round(avg(b0 * CASE scene WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END), 6) AS b0, count(*) AS n FROM px GROUP BY y, x"))(
    lambda s, d: C.composite(X.pixels(s, d), ["b0"], "mean", weights={1: 0.75, 2: 1.5, 3: 0.75}).select("y", "x", *_r("b0"), "n")
)

for _rule, _f in {"minallbands": "min", "maxallbands": "max"}.items():
    query(f"o086_composite_{_rule}", X.sql(PX, "SELECT y, x, " + ", ".join(f"{_f}({b}) AS {b}" for b in B) + ", count(*) AS n FROM px GROUP BY y, x"))(lambda s, d, rule=_rule: C.composite(X.pixels(s, d), B, rule))

query("o087_composite_mode", X.sql(PX, "v AS (SELECT y, x, b2, count(*) AS n FROM px GROUP BY ALL)", "SELECT y, x, arg_max(b2, row(n, -b2)) AS v FROM v GROUP BY y, x"))(lambda s, d: C.mode(X.pixels(s, d), "b2"))
query("o087_class_counts", X.sql(PX, "SELECT y, x, count_if(b2 = 1) AS n_1, count_if(b2 = 2) AS n_2 FROM px GROUP BY y, x"))(lambda s, d: C.mode(X.pixels(s, d), "b2", classes=[1, 2]))
query("o088_validity", X.sql(PX, "SELECT y, x, max(b0) AS b0, count(*) AS n FROM px WHERE b0 > 5 AND b0 < 45 AND b0 <> 20 GROUP BY y, x"))(lambda s, d: C.composite(X.pixels(s, d), ["b0"], "maxallbands", where=C.valid("b0", 5, 45, 20)))
query("o089_observations", X.sql(PX, "SELECT y, x, count(*) AS n, max(scene) AS seq FROM px WHERE b1 > 30 GROUP BY y, x"))(lambda s, d: C.composite(X.pixels(s, d), ["b1"], "overwrite", where=C.valid("b1", 30)).select("y", "x", "n", "seq"))
query("o090_mosaic_fill", X.sql(PX, "m AS (SELECT y, x, max(b0) AS b0 FROM px WHERE b1 > 45 GROUP BY y, x)", "SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(m.b0, -9999.0) AS b0 FROM range(0, 34) a(y) CROSS JOIN range(0, 34) b(x) LEFT JOIN m ON m.y = a.y AND m.x = b.x"))(
    lambda s, d: C.mosaic(C.composite(X.pixels(s, d), ["b0"], "maxallbands", where=C.valid("b1", 45)), ["b0"], 34, 34, -9999.0)
)
_FN = ["first", "last", "nvalid", "median", "min", "max", "sum", "var", "stdev", "mean", "percentile"]
query("o091_stat_profile", X.sql(PX, """SELECT y, x, arg_min(b0, scene) AS first, arg_max(b0, scene) AS last, count(b0) AS nvalid, median(b0) AS median, min(b0) AS min, max(b0) AS max, sum(b0) AS sum,
  round(var_pop(b0), 6) AS var, round(stddev_pop(b0), 6) AS stdev, round(avg(b0), 6) AS mean, round(quantile_cont(b0, 0.9), 6) AS percentile90 FROM px GROUP BY y, x"""))(
    lambda s, d: C.stat_profile(X.pixels(s, d), "b0", _FN, [90]).select("y", "x", "first", "last", "nvalid", "median", "min", "max", "sum", *_r("var", "stdev", "mean", "percentile90"))
)
query("o140_mosaic_union", X.sql(PX, "SELECT y, x, b0 FROM px WHERE scene = 1 UNION ALL SELECT y + 32, x, b0 FROM px WHERE scene = 2"))(
    lambda s, d: X.grid(s, d, 1).withColumnRenamed("v", "b0").unionByName(X.grid(s, d, 2).select((F.col("y") + 32).alias("y"), "x", F.col("v").alias("b0")))
)
query("o049_as_of", X.sql(X.SERIES, "m AS (SELECT pixel, t, v FROM se WHERE t % 3 = 0)", "SELECT o.pixel, o.t, o.v, m.t AS model_t, m.v AS model_v FROM (SELECT * FROM se WHERE t % 3 <> 0) o ASOF LEFT JOIN m ON o.pixel = m.pixel AND o.t >= m.t"))(
    lambda s, d: C.latest_before(X.series(s, d).where("t % 3 <> 0"), X.series(s, d).where("t % 3 = 0"), "pixel", "t").select("pixel", "t", "v", F.col("model.t").alias("model_t"), F.col("model.v").alias("model_v"))
)
