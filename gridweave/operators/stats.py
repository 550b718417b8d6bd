"""Global statistics: single aggregations with partial sums. NULL is nodata and never counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y of doubles as IEEE has it: by zero it is infinite, zero by zero NaN."""
    return F.when(y == 0, x * float("inf")).otherwise(F.try_divide(x, y))


def describe(df: DataFrame, v: str = "v", moments: tuple = (3, 4)) -> DataFrame:
    """One row of count, extremes (also by magnitude), sum, mean, median, population variance, deviation, skewness, excess kurtosis, raw moments."""
    c = F.col(v)
    return df.agg(
        F.count(c).alias("nvalid"), F.count_if(c.isNull()).alias("ninvalid"), F.min(c).alias("min"), F.max(c).alias("max"), F.min_by(c, F.struct(F.abs(c), c)).alias("absmin"), F.max_by(c, F.struct(F.abs(c), c)).alias("absmax"),
        F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.var_pop(c).alias("var"), F.stddev_pop(c).alias("stdev"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
        *[F.avg(F.pow(c, F.lit(m))).alias(f"moment{m}") for m in moments],
    )


def central_moment(df: DataFrame, n: int, v: str = "v") -> DataFrame:
    m = df.agg(F.avg(v).alias("m"))
    return df.join(F.broadcast(m)).agg(F.avg(F.pow(F.col(v) - F.col("m"), F.lit(n))).alias("central"))


def percentile(df: DataFrame, ps: list[float], v: str = "v") -> DataFrame:
    """Linear interpolation at (n - 1) p."""
    return df.agg(*[F.percentile(v, F.lit(p / 100)).alias(f"p{p:g}") for p in ps])


def equal_count_maxima(df: DataFrame, nbin: int, v: str = "v") -> DataFrame:
    """bin, v: largest value of each of nbin bins of n // nbin values; the remainder is left out. Ranks come from counts by value."""
    by = df.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))
    by = by.withColumn("upto", F.sum("n").over(W.orderBy("v"))).withColumn("size", F.floor(F.sum("n").over(W.partitionBy()) / nbin))
    k = F.sequence(F.floor((F.col("upto") - F.col("n")) / F.col("size")), F.floor((F.col("upto") - 1) / F.col("size")))
    # a bin's maximum is the value that holds its last rank
    hit = by.withColumn("bin", F.explode(k)).where(((F.col("bin") + 1) * F.col("size") > F.col("upto") - F.col("n")) & ((F.col("bin") + 1) * F.col("size") <= F.col("upto")) & (F.col("bin") < nbin))
    return hit.select(F.col("bin").cast("int").alias("bin"), "v")


def histogram(df: DataFrame, nbin: int, v: str = "v", lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, n for nbin bins (0: one a unit), the largest value in the last; empty bins count 0."""
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    r = r.select(F.coalesce(F.lit(lo), "lo").cast("double").alias("lo"), F.coalesce(F.lit(hi), "hi").cast("double").alias("hi"))
    r = r.withColumn("k", F.lit(nbin).cast("long") if nbin else (F.col("hi") - F.col("lo") + 1).cast("long"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(v) - F.col("lo")) * (F.col("k") - 1) / (F.col("hi") - F.col("lo")))).otherwise(0)
    n = df.join(F.broadcast(r)).where(F.col(v).between(F.col("lo"), F.col("hi"))).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = r.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    return frame.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram2d(df: DataFrame, a: str, b: str, nbin: int) -> DataFrame:
    """bx, by, n; the largest value falls in the last bin, so that one value alone does too."""
    r = df.agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0_"), F.max(b).alias("b1_"))
    at = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(nbin - 1), F.floor(F.try_divide((F.col(v) - F.col(lo)) * nbin, F.col(hi) - F.col(lo))))).otherwise(nbin - 1).cast("int")
    return df.join(F.broadcast(r)).groupBy(at(a, "a0", "a1").alias("bx"), at(b, "b0_", "b1_").alias("by")).agg(F.count("*").alias("n"))


def kernel_density(df: DataFrame, nbin: int, sigma: float | None = None, v: str = "v") -> DataFrame:
    """bin, x, density: Gaussian kernels (sigma: 1.06 sd n ** -0.2 if not given) around each distinct value, weighed by its count; NaN where all values are equal, for sigma is zero then."""
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.stddev_pop(v).alias("sd"))
    r = r.withColumn("s", F.lit(sigma) if sigma else F.col("sd") * 1.06 * F.pow("n", F.lit(-0.2)))
    by = df.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("v")).agg(F.count("*").alias("m"))
    x = by.join(F.broadcast(r)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbin - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / (nbin - 1))
    z = ratio(F.col("v") - F.col("x"), F.col("s"))
    return x.groupBy("bin").agg(F.first("x").alias("x"), (F.sum(ratio(F.col("m") * F.exp(-0.5 * z * z), F.col("s") * (2 * 3.141592653589793) ** 0.5)) / F.first("n")).alias("density"))


def extremes(g: DataFrame) -> DataFrame:
    """Smallest and largest value with their first positions in row order."""
    p = F.struct("y", "x")
    lo, hi = F.min_by(p, F.struct("v", "y", "x")), F.max_by(p, F.struct(F.col("v"), -F.col("y"), -F.col("x")))
    return g.where("v is not null").agg(F.min("v").alias("min"), lo.alias("a"), F.max("v").alias("max"), hi.alias("b")).select("min", F.col("a.y").alias("min_y"), F.col("a.x").alias("min_x"), "max", F.col("b.y").alias("max_y"), F.col("b.x").alias("max_x"))


def distinct_values(df: DataFrame, v: str = "v") -> DataFrame:
    return df.where(F.col(v).isNotNull()).select(F.col(v).cast("int").alias("v")).distinct()


def reference_pixel(g: DataFrame, ulx: float | None = None, uly: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Position of the lower left corner of the pixel that holds the centre of gravity of the valid ones; with ulx in map units, else in columns and rows."""
    cx, cy = F.avg("x"), F.avg("y")  # of indices, which lie half a pixel before centres
    x, y = F.floor(cx + 0.5).cast("double"), (F.floor(cy + 0.5) + 1).cast("double")
    if ulx is not None:
        x, y = F.lit(float(ulx)) + x * dx, F.lit(float(uly)) - (F.ceil(cy - 0.5) + 1) * dy
    return g.where("v is not null").agg(x.alias("ref_x"), y.alias("ref_y"))


def errors(df: DataFrame, a: str, b: str) -> DataFrame:
    """rmse; over the range of b; over the mean of b."""
    d = F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    return df.agg(d.alias("rmse"), (d / (F.max(b) - F.min(b))).alias("nrmse"), (d / F.avg(b)).alias("cvrmse"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = c0 + c1 x: c0, c1, r2, rmse, n."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_intercept(y, x).alias("c0"), F.regr_slope(y, x).alias("c1"), F.regr_r2(y, x).alias("r2"), F.regr_syy(y, x).alias("syy"), F.count("*").alias("n"))
    return r.select("c0", "c1", "r2", F.sqrt(F.col("syy") * (1 - F.col("r2")) / F.col("n")).alias("rmse"), "n")


def perpendicular_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """c1 = +- var(y) / var(x), by the sign of the correlation (none: 0); c0 through the means. NaN where x has one value alone."""
    r = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), correlation(x, y).alias("r"))
    c1 = ratio(F.when(F.isnan("r"), 0.0).otherwise(F.signum("r")) * F.col("vy"), F.col("vx"))
    return r.select(c1.alias("c1"), (F.col("my") - c1 * F.col("mx")).alias("c0"), (F.col("r") * F.col("r")).alias("r2"))


def correlation(a: str, b: str) -> Column:
    """Of rows that have both; NaN where either has one value alone."""
    return ratio(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias("cov"), correlation(a, b).alias("corr"))


def cross_correlation(df: DataFrame, by: str, t: str, a: str, b: str, most: int) -> DataFrame:
    """lag, r for lags -most .. most - 1: sum of (a - mean a)(b at t + lag - mean b) / (n - 1) / (sd a sd b), population deviations. A pair is an equi-join on the shifted time."""
    m = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.count("*").alias("n"))
    left = df.select(by, F.col(a).alias("va"), F.explode(F.sequence(F.lit(-most), F.lit(most - 1))).alias("lag"), t).withColumn("at", F.col(t) + F.col("lag")).drop(t)
    both = left.join(df.select(by, F.col(t).alias("at"), F.col(b).alias("vb")), [by, "at"]).join(F.broadcast(m))
    return both.groupBy("lag").agg((F.sum((F.col("va") - F.col("ma")) * (F.col("vb") - F.col("mb"))) / (F.first("n") - 1) / (F.first("sa") * F.first("sb"))).alias("r"))


def normalized(df: DataFrame, v: str = "v", percent: bool = False) -> DataFrame:
    """v over the sum of all (times 100); unchanged for a zero sum."""
    s = df.agg(F.sum(v).alias("__s"))
    return df.join(F.broadcast(s)).withColumn(v, F.when(F.col("__s") != 0, F.col(v) * (100.0 if percent else 1.0) / F.col("__s")).otherwise(F.col(v))).drop("__s")


def signature(df: DataFrame, v: str = "v") -> DataFrame:
    """Mean, and gamma-like shape and scale from the first two moments."""
    m, s = F.avg(v), F.var_pop(v)
    return df.agg(m.alias("k"), (m * m / s).alias("alpha"), (s / m).alias("beta"))


def masked_valid(v: Column, lo: float, hi: float) -> Column:
    return F.when((v >= lo) & (v <= hi), v)
