"""Grids, cubes, series and features derived from the driver's tables, and the same in SQL.

Bands hold whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, y, x, b0..b3: unique by (scene, y, x)."""
    t = table(spark, sf_dir, "lineitem")
    key = [F.col("l_linenumber").cast("int").alias("scene"), (F.col("l_orderkey") % SIDE).cast("int").alias("y"), (F.col("l_partkey") % SIDE).cast("int").alias("x")]
    return t.groupBy(*key).agg(
        F.max("l_quantity").alias("b0"),
        F.floor(F.max("l_extendedprice") / 1000).cast("double").alias("b1"),
        F.floor(F.max("l_discount") * 100 + 0.5).cast("double").alias("b2"),
        F.floor(F.max("l_tax") * 100 + 0.5).cast("double").alias("b3"),
    )


PIXELS = """px AS (SELECT CAST(l_linenumber AS INTEGER) AS scene, CAST(l_orderkey % 32 AS INTEGER) AS y, CAST(l_partkey % 32 AS INTEGER) AS x,
  max(l_quantity) AS b0, CAST(floor(max(l_extendedprice) / 1000) AS DOUBLE) AS b1, CAST(floor(max(l_discount) * 100 + 0.5) AS DOUBLE) AS b2,
  CAST(floor(max(l_tax) * 100 + 0.5) AS DOUBLE) AS b3 FROM lineitem GROUP BY 1, 2, 3)"""


def long(px: DataFrame, *bands: str) -> DataFrame:
    """scene, y, x, band, v."""
    bands = bands or ("b0", "b1", "b2", "b3")
    pairs = ", ".join(f"{i}, {b}" for i, b in enumerate(bands))
    return px.selectExpr("scene", "y", "x", f"stack({len(bands)}, {pairs}) AS (band, v)")


LONG = "pl AS (SELECT scene, y, x, 0 AS band, b0 AS v FROM px UNION ALL SELECT scene, y, x, 1, b1 FROM px UNION ALL SELECT scene, y, x, 2, b2 FROM px UNION ALL SELECT scene, y, x, 3, b3 FROM px)"


def grid(spark: SparkSession, sf_dir: str, scene: int = 1, band: str = "b0") -> DataFrame:
    """y, x, v of one scene."""
    return pixels(spark, sf_dir).where(F.col("scene") == scene).select("y", "x", F.col(band).alias("v"))


GRID = "g AS (SELECT y, x, b0 AS v FROM px WHERE scene = 1)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, bands (64 whole numbers), label."""
    t = table(spark, sf_dir, "embeddings")
    return t.select((F.col("vec_id") / 64).cast("int").alias("y"), (F.col("vec_id") % 64).cast("int").alias("x"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("double")).alias("bands"), "label")


CUBE = """cb AS (SELECT CAST(vec_id // 64 AS INTEGER) AS y, CAST(vec_id % 64 AS INTEGER) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) - 1 AS b,
  floor(CAST(unnest(embedding) AS DOUBLE) * 100) AS v, label FROM embeddings)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel, t (day), v: daily counts by user, a whole number."""
    t = table(spark, sf_dir, "events")
    return t.groupBy((F.col("user_id") % 50).alias("pixel"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("t")).agg(F.count("*").cast("double").alias("v"))


SERIES = "se AS (SELECT user_id % 50 AS pixel, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, returns: scattered points with a height."""
    t = table(spark, sf_dir, "part")
    return t.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7) % 32 + 0.25).cast("double").alias("x"), ((F.col("p_size") * 13) % 32 + 0.75).cast("double").alias("y"), F.floor("p_retailprice").cast("double").alias("z"), (F.col("p_partkey") % 3 + 1).cast("int").alias("return_no"), F.lit(3).alias("n_returns"), (F.col("p_size") % 4).cast("int").alias("class"))


POINTS = "pt AS (SELECT p_partkey AS id, CAST((p_partkey * 7) % 32 + 0.25 AS DOUBLE) AS x, CAST((p_size * 13) % 32 + 0.75 AS DOUBLE) AS y, CAST(floor(p_retailprice) AS DOUBLE) AS z, CAST(p_partkey % 3 + 1 AS INTEGER) AS return_no, 3 AS n_returns, CAST(p_size % 4 AS INTEGER) AS class FROM part)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, ring: triangles and squares as closed rings of (x, y) in pixel coordinates."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fid"), ((F.col("n_nationkey") * 5) % 24).cast("double").alias("x0"), ((F.col("n_nationkey") * 7) % 24).cast("double").alias("y0"))
    p = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    square = F.array(p(0.0, 0.0), p(6.0, 0.0), p(6.0, 6.0), p(0.0, 6.0), p(0.0, 0.0))
    triangle = F.array(p(0.0, 0.0), p(7.3, 0.0), p(0.0, 7.3), p(0.0, 0.0))
    return t.select("fid", F.when(F.col("fid") % 2 == 0, square).otherwise(triangle).alias("ring"))


#: Cells whose centre lies within a zone.
ZONES = """zn AS (SELECT n_nationkey AS fid, CAST((n_nationkey * 5) % 24 AS DOUBLE) AS x0, CAST((n_nationkey * 7) % 24 AS DOUBLE) AS y0 FROM nation),
zc AS (SELECT fid, CAST(cy AS INTEGER) AS y, CAST(cx AS INTEGER) AS x FROM zn, range(0, 32) a(cx), range(0, 32) b(cy)
  WHERE cx + 0.5 > x0 AND cy + 0.5 > y0 AND CASE WHEN fid % 2 = 0 THEN cx + 0.5 < x0 + 6 AND cy + 0.5 < y0 + 6 ELSE (cx + 0.5 - x0) + (cy + 0.5 - y0) < 7.3 END)"""


def classmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, ref, cls: a reference class map and a classified one."""
    return cube(spark, sf_dir).select("y", "x", F.col("label").alias("ref"), ((F.col("label") + F.when((F.col("y") + F.col("x")) % 3 == 0, 1).otherwise(0)) % 10).alias("cls"))


CLASSMAPS = "cm AS (SELECT CAST(vec_id // 64 AS INTEGER) AS y, CAST(vec_id % 64 AS INTEGER) AS x, label AS ref, (label + CASE WHEN (vec_id // 64 + vec_id % 64) % 3 = 0 THEN 1 ELSE 0 END) % 10 AS cls FROM embeddings)"


def sql(*parts: str) -> str:
    """WITH all parts but the last, which selects."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
