"""Composites of several scenes by pixel: one shuffle on (y, x), with partial aggregation before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

KEY = ["y", "x"]


def valid(band: str, lo: float | None = None, hi: float | None = None, nodata: float | None = None) -> Column:
    """Not at or below lo, at or above hi, or equal to nodata."""
    c = F.col(band).isNotNull()
    if lo is not None:
        c = c & (F.col(band) > lo)
    if hi is not None:
        c = c & (F.col(band) < hi)
    return c & (F.col(band) != nodata) if nodata is not None else c


def _bands(pick: Column, bands: list[str]) -> list[Column]:
    return [pick[b].alias(b) for b in bands]


def composite(px: DataFrame, bands: list[str], rule: str = "overwrite", where: Column | None = None, weights: dict | None = None, red: str = "b0", nir: str = "b1", rule_band: str = "b0") -> DataFrame:
    """y, x, bands and n (observations), seq (chosen scene where one is). px: scene, y, x, bands; scenes in order of their number.

    Rules: overwrite (last valid), maxndvi (last of the largest), maxband and minband (first of the extreme), validband (last), mean, median,
    sum, stdev (population), minallbands, maxallbands. weights: by scene, multiplied into values of the statistics and of the compared band."""
    px = px.where(where) if where is not None else px
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("scene")], F.lit(1.0)) if weights else F.lit(1.0)
    all_ = F.struct(*bands, "scene")
    n = F.count("*").alias("n")
    if rule in ("overwrite", "validband", "maxndvi", "maxband", "minband"):
        ndvi = F.when((F.col(nir) >= 0) & (F.col(red) >= 0) & (F.col(nir) + F.col(red) > 0), (F.col(nir) - F.col(red)) / (F.col(nir) + F.col(red))).otherwise(0.0)
        value = F.col(rule_band) * w
        pick = {
            "overwrite": lambda: F.max_by(all_, F.col("scene")), "validband": lambda: F.max_by(all_, F.col("scene")), "maxndvi": lambda: F.max_by(all_, F.struct(ndvi, F.col("scene"))),
            "maxband": lambda: F.max_by(all_, F.struct(value, -F.col("scene"))), "minband": lambda: F.min_by(all_, F.struct(value, F.col("scene"))),
        }[rule]()
        got = px.groupBy(*KEY).agg(pick.alias("p"), n)
        return got.select(*KEY, *_bands(F.col("p"), bands), "n", F.col("p.scene").alias("seq"))
    f = {"mean": F.avg, "median": F.median, "sum": F.sum, "stdev": F.stddev_pop, "minallbands": F.min, "maxallbands": F.max}[rule]
    return px.groupBy(*KEY).agg(*[f(F.col(b) * w).alias(b) for b in bands], n)


def mode(px: DataFrame, band: str, weights: dict | None = None, classes: list | None = None) -> DataFrame:
    """y, x, v: the value of most votes (the lowest wins ties); or, by class list, n_<class> counts."""
    if classes:
        return px.groupBy(*KEY).agg(*[F.count_if(F.col(band) == c).alias(f"n_{c}") for c in classes])
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("scene")], F.lit(1.0)) if weights else F.lit(1.0)
    votes = px.groupBy(*KEY, F.col(band).alias("v")).agg(F.sum(w).alias("n"))
    return votes.groupBy(*KEY).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))


def mosaic(composited: DataFrame, bands: list[str], height: int, width: int, fill: float) -> DataFrame:
    """The whole output grid, with fill where no scene covers it."""
    s = composited.sparkSession
    frame = s.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return frame.join(composited, KEY, "left").select(*KEY, *[F.coalesce(F.col(b), F.lit(fill)).alias(b) for b in bands])


#: Functions of a profile by name; percentile takes its threshold from a list, in order.
PROFILE = {
    "first": lambda v, s: F.min_by(v, s), "last": lambda v, s: F.max_by(v, s), "nvalid": lambda v, s: F.count(v), "median": lambda v, s: F.median(v), "min": lambda v, s: F.min(v), "max": lambda v, s: F.max(v),
    "sum": lambda v, s: F.sum(v), "var": lambda v, s: F.var_pop(v), "stdev": lambda v, s: F.stddev_pop(v), "mean": lambda v, s: F.avg(v),
}


def stat_profile(px: DataFrame, band: str, functions: list[str], percentiles: list[float] = (95,)) -> DataFrame:
    """y, x and one column for each function over the scenes."""
    todo, out = list(percentiles), []
    for f in functions:
        if f == "percentile":
            p = todo.pop(0) if len(todo) > 1 else todo[0]
            out.append(F.percentile(band, F.lit(p / 100)).alias(f"percentile{p:g}"))
        else:
            out.append(PROFILE[f](F.col(band), F.col("scene")).alias(f))
    return px.groupBy(*KEY).agg(*out)


def latest_before(obs: DataFrame, model: DataFrame, by: str, t: str) -> DataFrame:
    """Backward as-of join on whole-number times: each observation with the last model time at or before it. One
    sort of both by (by, t) and no range join."""
    a = obs.select(by, t, *[c for c in obs.columns if c not in (by, t)], F.lit(1).alias("__o"))
    m = model.select(by, t, F.struct(*[c for c in model.columns if c != by]).alias("__m"), F.lit(0).alias("__o"))
    w = W.partitionBy(by).orderBy(t, "__o").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(m, allowMissingColumns=True).withColumn("__m", F.last("__m", ignorenulls=True).over(w))
    return both.where("__o = 1").drop("__o").withColumnRenamed("__m", "model")
