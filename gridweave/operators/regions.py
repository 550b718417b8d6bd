"""Regions of equal value: connected components, sieve, outlines; and filling of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["y", "x"]
FOUR = [(0, 1), (1, 0)]
EIGHT = [(0, 1), (1, 0), (1, 1), (1, -1)]


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder is known that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridweave-"))
    return df.checkpoint()


def neighbours(g: DataFrame, directions: list[tuple[int, int]]) -> DataFrame:
    """Each pair of adjacent pixels once: y, x, v and y2, x2, v2."""
    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in directions])
    a = g.select("y", "x", "v", F.explode(k).alias("k")).select("y", "x", "v", (F.col("y") + F.col("k.i")).alias("y2"), (F.col("x") + F.col("k.j")).alias("x2"))
    return a.join(g.select(F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("v").alias("v2")), ["y2", "x2"])


def regions(g: DataFrame, directions: list[tuple[int, int]] = FOUR) -> DataFrame:
    """y, x, v, region: the least pixel number (row-major, by 2**31) of the connected pixels of equal value. Alternating stars: rounds grow with the
    logarithm of a region's diameter, and each is an aggregation and a join on labels."""
    node = lambda y, x: F.col(y).cast("long") * (1 << 31) + F.col(x)
    e = neighbours(g.where("v is not null"), directions).where("v = v2").select(node("y", "x").alias("a"), node("y2", "x2").alias("b"))
    e = durable(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        deep = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if deep.unionByName(e.join(many, "u", "left_semi")).isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.where("u <> v").distinct())
    out = g.where("v is not null").withColumn("u", node("y", "x")).join(e.withColumnRenamed("v", "root"), "u", "left")
    return out.select("y", "x", "v", F.coalesce("root", "u").alias("region"))


def sieve(g: DataFrame, size: int, directions: list[tuple[int, int]] = FOUR) -> DataFrame:
    """y, x, v: regions below `size` pixels take the value of their largest neighbour region (the lowest number wins ties). What is still small then goes on, round by
    round, until every region is large enough or has no neighbour. Of two small neighbours only one moves in a round: the smaller, or that of the higher number."""
    while True:
        r = durable(regions(g, directions))
        area = r.groupBy("region", "v").agg(F.count("*").alias("n"))
        touch = neighbours(r.select("y", "x", F.col("region").alias("v")), directions).where("v <> v2")
        pairs = touch.select("v", "v2").unionByName(touch.select(F.col("v2").alias("v"), F.col("v").alias("v2"))).distinct()
        best = pairs.join(area.select(F.col("region").alias("v2"), F.col("v").alias("to"), "n"), "v2").groupBy("v").agg(F.max(F.struct("n", -F.col("v2"), "to")).alias("b"))
        small = area.where(F.col("n") < size).join(best.withColumnRenamed("v", "region"), "region")
        small = durable(small.where(F.struct("n", -F.col("region")) < F.struct(F.col("b")["n"], F.col("b")["col2"])).select("region", F.col("b")["to"].alias("to")))
        if small.isEmpty():
            return r.select("y", "x", "v")
        g = r.join(small, "region", "left").select("y", "x", F.coalesce("to", "v").alias("v"))


def polygonize(g: DataFrame, directions: list[tuple[int, int]] = FOUR) -> DataFrame:
    """region, v, n (pixels), edges (array of unit boundary segments x0, y0, x1, y1; the region lies to their left): edges shared by two pixels of a region cancel."""
    r = durable(regions(g, directions))
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(d).alias("d")) for a, b, c, d in ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))])
    e = r.select("region", "v", "y", "x", F.explode(sides).alias("s")).select("region", "v", (F.col("x") + F.col("s.a")).alias("x0"), (F.col("y") + F.col("s.b")).alias("y0"), (F.col("x") + F.col("s.c")).alias("x1"), (F.col("y") + F.col("s.d")).alias("y1"))
    low = F.struct(F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1"))
    one = e.groupBy("region", "v", low.alias("k")).agg(F.count("*").alias("n"), F.first(F.struct("x0", "y0", "x1", "y1")).alias("e")).where("n = 1")
    n = r.groupBy("region").agg(F.count("*").alias("n"))
    return one.groupBy("region", "v").agg(F.sort_array(F.collect_list("e")).alias("edges")).join(n, "region")


def fill_nodata(g: DataFrame, reach: int) -> DataFrame:
    """y, x, v: NULL pixels become the inverse-distance mean of valid ones within `reach` cells along rows, columns and diagonals around them."""
    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1.0 / (i * i + j * j) ** 0.5).alias("w")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i or j) and i * i + j * j <= reach * reach])
    holes = g.where("v is null").select("y", "x", F.explode(k).alias("k")).select("y", "x", "k.w", (F.col("y") + F.col("k.i")).alias("y2"), (F.col("x") + F.col("k.j")).alias("x2"))
    got = holes.join(g.where("v is not null").select(F.col("y").alias("y2"), F.col("x").alias("x2"), "v"), ["y2", "x2"]).groupBy("y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("f"))
    return g.join(got, KEY, "left").select("y", "x", F.coalesce("v", "f").alias("v"))
