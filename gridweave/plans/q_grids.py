"""Grid geometry, crops and joins of grids, regions, sources and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import regions as R
from ..registry import query
from ..sources import raster as S
from . import fixtures as X

BASE = (X.PIXELS, X.GRID)
N = X.SIDE
FULL = G.Grid(0.0, 32.0, 1.0, 1.0, N, N)


def _r(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes])


_BOX = G.Grid(4.0, 30.0, 1.0, 1.0, 10, 12)
query("o031_crop_box", X.sql(*BASE, "SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(g.v, -1.0) AS v FROM range(0, 10) a(y) CROSS JOIN range(0, 12) b(x) LEFT JOIN g ON g.y = a.y + 2 AND g.x = b.x + 4"))(lambda s, d: G.crop(X.grid(s, d), FULL, _BOX, ["v"], -1.0))
_HALF = FULL.cropped(2.5, 20.0, 9.5, 11.0, align=True, dx=0.5, dy=0.5)
query("o031_crop_finer_near", X.sql(*BASE, f"SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, g.v FROM range(0, {_HALF.height}) a(y) CROSS JOIN range(0, {_HALF.width}) b(x) LEFT JOIN g ON g.y = floor((a.y + 0.5) / 2 + 12) AND g.x = floor((b.x + 0.5) / 2 + 2.5)"))(lambda s, d: G.crop(X.grid(s, d), FULL, _HALF, ["v"]))
query("o032_stack_bands", X.sql(X.PIXELS, "SELECT a.y, a.x, a.b0 AS b0, b.b0 AS b1, b.b1 AS b2 FROM px a JOIN px b ON a.y = b.y AND a.x = b.x WHERE a.scene = 1 AND b.scene = 2"))(
    lambda s, d: G.stack([X.pixels(s, d).where("scene = 1"), X.pixels(s, d).where("scene = 2")], [["b0"], ["b0", "b1"]])
)
_SC = "sc AS (SELECT n_nationkey AS scene, CAST((n_nationkey * 5) % 24 AS DOUBLE) AS ulx, CAST((n_nationkey * 7) % 24 + 6 AS DOUBLE) AS uly, CAST((n_nationkey * 5) % 24 + 6 AS DOUBLE) AS lrx, CAST((n_nationkey * 7) % 24 AS DOUBLE) AS lry FROM nation)"


def _scenes(s, d):
    t = X.table(s, d, "nation")
    x, y = (F.col("n_nationkey") * 5) % 24, (F.col("n_nationkey") * 7) % 24
    return t.select(F.col("n_nationkey").alias("scene"), x.cast("double").alias("ulx"), (y + 6).cast("double").alias("uly"), (x + 6).cast("double").alias("lrx"), y.cast("double").alias("lry"))


query("o034_filter_geo", X.sql(_SC, "SELECT * FROM sc WHERE ulx < 10 AND lrx > 5 AND lry < 14 AND uly > 8"))(lambda s, d: G.overlaps(_scenes(s, d), 5, 14, 10, 8))
query("o047_scene_overlap", X.sql(_SC, "SELECT scene FROM sc WHERE ulx < 20 AND lrx > 18 AND lry < 9 AND uly > 2"))(lambda s, d: G.overlaps(_scenes(s, d), 18, 9, 20, 2).select("scene"))
query("o141_union_box", X.sql(_SC, "SELECT min(ulx) AS ulx, max(uly) AS uly, max(lrx) AS lrx, min(lry) AS lry FROM sc"))(lambda s, d: G.union_box(_scenes(s, d)))
query("o141_intersection_box", X.sql(_SC, "t AS (SELECT max(ulx) AS ulx, min(uly) AS uly, min(lrx) AS lrx, max(lry) AS lry FROM sc WHERE scene IN (0, 5, 24))", "SELECT CASE WHEN ulx < lrx AND lry < uly THEN ulx END AS ulx, CASE WHEN ulx < lrx AND lry < uly THEN uly END AS uly, CASE WHEN ulx < lrx AND lry < uly THEN lrx END AS lrx, CASE WHEN ulx < lrx AND lry < uly THEN lry END AS lry FROM t"))(
    lambda s, d: G.intersection_box(_scenes(s, d).where(F.col("scene").isin(0, 5, 24)))
)
query("o143_box_with_option", X.sql(_SC, "SELECT scene, greatest(ulx, 5.0) AS ulx, least(uly, 20.0) AS uly, least(lrx, 18.0) AS lrx, greatest(lry, 3.0) AS lry FROM sc"))(
    lambda s, d: _scenes(s, d).select("scene", F.greatest("ulx", F.lit(5.0)).alias("ulx"), F.least("uly", F.lit(20.0)).alias("uly"), F.least("lrx", F.lit(18.0)).alias("lrx"), F.greatest("lry", F.lit(3.0)).alias("lry"))
)
_COARSE = G.Grid(0.0, 32.0, 2.0, 2.0, 16, 16)
query("o040_colocate_nearest", X.sql(X.PIXELS, "SELECT a.y, a.x, a.b0 AS v, b.b1 AS w FROM px a JOIN px b ON b.y = a.y // 2 AND b.x = a.x // 2 WHERE a.scene = 1 AND b.scene = 2 AND b.y < 16 AND b.x < 16"))(
    lambda s, d: G.nearest(X.grid(s, d), FULL, X.grid(s, d, 2, "b1").where("y < 16 and x < 16").withColumnRenamed("v", "w"), _COARSE, ["w"]).select("y", "x", "v", "w")
)
query("o041_colocate_bilinear", X.sql(*BASE, "t AS (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, a.y * 2 + 0.5 AS r, b.x * 2 + 0.5 AS c FROM range(0, 16) a(y), range(0, 16) b(x))",
    "SELECT t.y, t.x, round(sum(g.v * (1 - abs(r - g.y)) * (1 - abs(c - g.x))) / sum((1 - abs(r - g.y)) * (1 - abs(c - g.x))), 6) AS v FROM t JOIN g ON abs(r - g.y) < 1 AND abs(c - g.x) < 1 GROUP BY t.y, t.x"))(
    lambda s, d: _r(G.bilinear(G.frame(s, _COARSE), _COARSE, X.grid(s, d), FULL, "v"))
)
query("o042_mask_other_grid", X.sql(X.PIXELS, "SELECT a.y, a.x, CASE WHEN m.b2 > 5 THEN 0.0 ELSE a.b0 END AS v FROM (SELECT * FROM px WHERE scene = 1) a LEFT JOIN (SELECT * FROM px WHERE scene = 2 AND y < 10 AND x < 10) m ON m.y = a.y // 2 AND m.x = a.x // 2"))(
    lambda s, d: X.grid(s, d).join(G.nearest(G.frame(s, FULL), FULL, X.grid(s, d, 2, "b2").where("y < 10 and x < 10").withColumnRenamed("v", "m"), _COARSE, ["m"]), ["y", "x"], "left").select("y", "x", F.when(F.col("m") > 5, 0.0).otherwise(F.col("v")).alias("v"))
)
query("o048_label_lookup", X.sql(X.CLASSMAPS, "SELECT y, x, ref, n_name AS name FROM cm JOIN nation ON n_nationkey = ref"))(lambda s, d: X.classmaps(s, d).select("y", "x", "ref").join(X.table(s, d, "nation").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("name")), "ref").select("y", "x", "ref", "name"))

# --- regions ------------------------------------------------------------------------------------------------------

_COARSE_V = "g AS (SELECT y, x, CAST(b2 > 4 AS INTEGER) + 0.0::DOUBLE AS v FROM px WHERE scene = 1)"


def _two_level(s, d):
    return X.grid(s, d, band="b2").withColumn("v", (F.col("v") > 4).cast("double"))


_CC = """WITH RECURSIVE {px}, {g}, e AS (SELECT a.y * 2147483648 + a.x AS u, b.y * 2147483648 + b.x AS w FROM g a JOIN g b ON a.v = b.v AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
  r AS (SELECT y * 2147483648 + x AS u, y * 2147483648 + x AS m FROM g UNION SELECT e.w, r.m FROM r JOIN e ON e.u = r.u),
  reg AS (SELECT g.y, g.x, g.v, CAST(min(r.m) AS BIGINT) AS region FROM g JOIN r ON r.u = g.y * 2147483648 + g.x GROUP BY ALL) """.format(px=X.PIXELS, g=_COARSE_V)
query("o145_regions")(lambda s, d: R.regions(_two_level(s, d)))
query("o144_sieve")(lambda s, d: R.sieve(_two_level(s, d), 5))
query("o145_polygonize")(lambda s, d: R.polygonize(_two_level(s, d)).select("region", "v", "n", F.size("edges").alias("n_edges")))
query("o146_fill_nodata", X.sql(X.PIXELS, "g AS (SELECT y, x, CASE WHEN b2 = 3 THEN NULL ELSE b0 END AS v FROM px WHERE scene = 1)",
    "f AS (SELECT a.y, a.x, sum(b.v / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) / sum(1 / sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS f FROM g a JOIN g b ON b.v IS NOT NULL AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4 WHERE a.v IS NULL GROUP BY 1, 2)", "SELECT g.y, g.x, round(coalesce(g.v, f.f), 6) AS v FROM g LEFT JOIN f ON g.y = f.y AND g.x = f.x"))(
    lambda s, d: _r(R.fill_nodata(X.pixels(s, d).where("scene = 1").select("y", "x", F.when(F.col("b2") != 3, F.col("b0")).alias("v")), 2))
)
_CELL = "SELECT p_partkey AS id, CAST(4300000 + p_partkey * 37 AS DOUBLE) AS x, CAST(3200000 + p_size * 53 AS DOUBLE) AS y FROM part"


def _cells(s, d):
    return X.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 37 + 4300000).cast("double").alias("x"), (F.col("p_size") * 53 + 3200000).cast("double").alias("y"))


def _box_and_middle(code, k):
    box, middle = G.cell_box(code, 8, k), G.cell_middle(code, 8, k)
    return box["ulx"].alias("ulx"), box["uly"].alias("uly"), middle["x"].alias("mx"), middle["y"].alias("my")


query("o150_cell_code", f"SELECT id, CAST(CAST(floor(x / 1000) AS BIGINT) AS VARCHAR) || CAST(CAST(floor(y / 1000) AS BIGINT) AS VARCHAR) || '-' || CASE WHEN x % 1000 >= 500 AND y % 1000 >= 500 THEN 'D' WHEN x % 1000 >= 500 THEN 'B' WHEN y % 1000 >= 500 THEN 'C' ELSE 'A' END AS code FROM ({_CELL})")(
    lambda s, d: _cells(s, d).select("id", G.geo_to_cell(F.col("x"), F.col("y"), 9).alias("code"))
)
query("o150_cell_box", f"SELECT id, floor(x / 250) * 250 AS ulx, floor(y / 250) * 250 + 250 AS uly, floor(x / 250) * 250 + 125 AS mx, floor(y / 250) * 250 + 125 AS my FROM ({_CELL})")(
    lambda s, d: _cells(s, d).select("id", G.geo_to_cell(F.col("x"), F.col("y"), 8).alias("code"), F.length(G.tile_digits(F.col("x"), 8)).alias("k")).select("id", *_box_and_middle(F.col("code"), F.col("k")))
)

# --- sources and metadata -----------------------------------------------------------------------------------------

query("o001_read_rows", X.sql(X.PIXELS, "SELECT * FROM px WHERE scene IN (1, 3) AND y BETWEEN 4 AND 9"))(lambda s, d: X.pixels(s, d).where(F.col("scene").isin(1, 3) & F.col("y").between(4, 9)))
query("o003_clone_template", X.sql(X.PIXELS, "SELECT y, x, 0.0::DOUBLE AS v FROM px WHERE scene = 1"))(lambda s, d: X.grid(s, d).withColumn("v", F.lit(0.0)))
query("o006_new_raster", "SELECT CAST(i // 40 AS INTEGER) AS y, CAST(i % 40 AS INTEGER) AS x, 7.0::DOUBLE AS b0, 9.0::DOUBLE AS b1 FROM range(1200) t(i)")(lambda s, d: S.new_raster(s, 30, 40, [7, 9]).select("y", "x", F.col("bands")[0].alias("b0"), F.col("bands")[1].alias("b1")))
query("o006_cast_types", X.sql(X.PIXELS, "SELECT scene, y, x, CAST(least(255, CAST(trunc(b1 * 10) AS BIGINT)) AS SMALLINT) AS byte, CAST(greatest(-32768, CAST(trunc(-b1 * 1000) AS BIGINT)) AS SMALLINT) AS int16 FROM px"))(
    lambda s, d: X.pixels(s, d).select("scene", "y", "x", S.cast_type(F.col("b1") * 10, "Byte").alias("byte"), S.cast_type(-F.col("b1") * 1000, "Int16").alias("int16"))
)
query("o008_color_lookup", X.sql(*BASE, "SELECT y, x, v, CAST(v AS INTEGER) AS r, CAST(v AS INTEGER) AS g, CAST(v AS INTEGER) AS b, 255 AS a FROM g"))(lambda s, d: S.colored(X.grid(s, d), S.color_table(s)))
query("o022_color_table", "SELECT CAST(i AS INTEGER) AS id, CAST(greatest(0, 2 * i - 255) AS INTEGER) AS r, CAST(255 - abs(2 * i - 255) AS INTEGER) AS g, CAST(greatest(0, 255 - 2 * i) AS INTEGER) AS b, 255 AS a FROM range(256) t(i)")(lambda s, d: S.color_table(s, ramp=True))
query("o009_vector_read", "SELECT p_brand AS label, count(*) AS n, sum(p_size) AS total FROM part GROUP BY p_brand")(lambda s, d: X.table(s, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total")))
query("o010_training_read", X.sql(X.CUBE, "SELECT label, y, x, max(CASE WHEN b = 2 THEN v END) AS b2, max(CASE WHEN b = 5 THEN v END) AS b5 FROM cb GROUP BY label, y, x"))(lambda s, d: X.cube(s, d).select("label", "y", "x", F.col("bands")[2].alias("b2"), F.col("bands")[5].alias("b5")))


@query("o011_sql_pass_through", X.sql(*BASE, "SELECT y, count(*) AS n, max(v) AS top FROM g WHERE x BETWEEN 3 AND 20 GROUP BY y HAVING count(*) > 2"))
def _(s, d):
    X.grid(s, d).createOrReplaceTempView("layer_g")
    return s.sql("SELECT y, count(*) AS n, max(v) AS top FROM layer_g WHERE x BETWEEN 3 AND 20 GROUP BY y HAVING count(*) > 2")


query("o012_layer_extent", X.sql(X.POINTS, "SELECT min(x) AS ulx, max(y) AS uly, max(x) AS lrx, min(y) AS lry, count(*) AS n FROM pt"))(lambda s, d: X.points(s, d).agg(F.min("x").alias("ulx"), F.max("y").alias("uly"), F.max("x").alias("lrx"), F.min("y").alias("lry"), F.count("*").alias("n")))
query("o013_polygons_from_points", X.sql(X.POINTS, "SELECT class AS fid, count(*) + 1 AS n FROM pt GROUP BY class"))(lambda s, d: S.as_polygon(X.points(s, d), "id", "class").select("fid", F.size("ring").cast("long").alias("n")))
query("o017_dump_matrix", X.sql(*BASE, "SELECT y, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY x) AS line FROM g GROUP BY y"))(lambda s, d: S.dump_matrix(X.grid(s, d)))
query("o017_dump_list", X.sql(*BASE, "SELECT x, y, v FROM g"))(lambda s, d: S.dump_list(X.grid(s, d)))
query("o018_dump_transposed", "SELECT 'n_name' AS field, max(CASE WHEN n_nationkey = 1 THEN n_name END) AS \"1\", max(CASE WHEN n_nationkey = 2 THEN n_name END) AS \"2\" FROM nation UNION ALL SELECT 'n_regionkey', max(CASE WHEN n_nationkey = 1 THEN CAST(n_regionkey AS VARCHAR) END), max(CASE WHEN n_nationkey = 2 THEN CAST(n_regionkey AS VARCHAR) END) FROM nation")(
    lambda s, d: S.transposed(X.table(s, d, "nation").where(F.col("n_nationkey").isin(1, 2)).select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
)
query("o020_point_filters", X.sql(X.POINTS, "SELECT id, x, y, z FROM pt WHERE return_no = n_returns AND class IN (0, 3)"))(lambda s, d: X.points(s, d).where((F.col("return_no") == F.col("n_returns")) & F.col("class").isin(0, 3)).select("id", "x", "y", "z"))
query("o021_info", X.sql(X.PIXELS, "SELECT scene, max(y) + 1 AS nl, max(x) + 1 AS ns, 1 AS nb, min(b0) AS min_b0, max(b0) AS max_b0, round(avg(b0), 6) AS mean_b0, 0.0::DOUBLE AS ulx, 32.0::DOUBLE AS uly, max(x) + 1.0::DOUBLE AS lrx, 32.0::DOUBLE - (max(y) + 1) AS lry, (max(x) + 1) / 2 AS cx, (64.0::DOUBLE - (max(y) + 1)) / 2 AS cy FROM px GROUP BY scene"))(lambda s, d: _r(S.info(X.pixels(s, d), ["b0"], uly=32.0)))
