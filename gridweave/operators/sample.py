"""Sampling and top-k. Draws are hashes of the row's key: the same in every run, and with no ordering of whole classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def chance(key: list[str], seed: int = 1) -> Column:
    """Uniform in [0, 1) by key, from an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def percent(df: DataFrame, key: list[str], p: float, seed: int = 1) -> DataFrame:
    return df.where(chance(key, seed) < p / 100)


def top(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first k rows: each task keeps k, one merges them."""
    return df.orderBy(*by).limit(k)


def at_most(df: DataFrame, by: str, key: list[str], k: int, seed: int = 1) -> DataFrame:
    """k rows of each class: those of least draw. Rows far over the class's k-th draw never reach the ranking: k of n rows lie below about k / n, and the margin of 6 deviations misses none in practice; a class that falls short is ranked whole."""
    u = chance(key, seed)
    n = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    bound = (k + 6 * k**0.5 + 16) / F.col("__n")
    d = df.withColumn("__u", u).join(n, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__in", F.col("__u") < bound)
    short = d.groupBy("__by").agg(F.count_if("__in").alias("__m")).where(F.col("__m") < k).select(F.col("__by").alias("__s"), F.lit(True).alias("__all"))
    d = d.join(short, F.col("__by").eqNullSafe(F.col("__s")), "left").where("__in or __all")
    w = W.partitionBy("__by").orderBy("__u", *key)
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select(*df.columns)


def balanced(df: DataFrame, by: str, key: list[str], k: int, seed: int = 1) -> DataFrame:
    """Exactly k rows of each class: drawn from larger ones, repeated in turn in smaller ones; copy: number of the repeat."""
    some = at_most(df, by, key, k, seed)
    n = some.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    w = W.partitionBy("__by").orderBy(*key)  # k rows at most
    d = some.join(n, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__r", F.row_number().over(w) - 1)
    times = F.floor((F.lit(k) - F.col("__r") - 1) / F.col("__n")) + 1
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).select(*df.columns, F.col("copy").cast("int").alias("copy"))


def thinned(g: DataFrame, down: int) -> DataFrame:
    return g.where((F.col("y") % down == 0) & (F.col("x") % down == 0))


def grid_points(spark, height: int, width: int, step: int) -> DataFrame:
    """Systematic points: id, y, x."""
    ny, nx = -(-height // step), -(-width // step)
    return spark.range(ny * nx).select("id", ((F.floor(F.col("id") / nx)) * step).cast("int").alias("y"), ((F.col("id") % nx) * step).cast("int").alias("x"))


def random_points(spark, n: int, height: float, width: float, seed: int = 1) -> DataFrame:
    """n points uniform in a box, by id."""
    d = spark.range(n)
    return d.select("id", (chance(["id"], seed) * height).alias("y"), (chance(["id"], seed + 1) * width).alias("x"))
