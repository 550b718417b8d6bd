"""Accuracy: confusion matrices, image differences, validation against samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, ref: str, cls: str, weight: str | None = None) -> DataFrame:
    """ref, cls, n."""
    return df.where(F.col(ref).isNotNull() & F.col(cls).isNotNull()).groupBy(F.col(ref).alias("ref"), F.col(cls).alias("cls")).agg((F.sum(weight) if weight else F.count("*").cast("double")).alias("n"))


def by_class(m: DataFrame) -> DataFrame:
    """class, n_ref, n_cls, hit, pa, ua and their standard errors (in %)."""
    r = m.groupBy(F.col("ref").alias("class")).agg(F.sum("n").alias("n_ref"), F.sum(F.when(F.col("ref") == F.col("cls"), F.col("n")).otherwise(0.0)).alias("hit"))
    c = m.groupBy(F.col("cls").alias("class")).agg(F.sum("n").alias("n_cls"))
    j = r.join(c, "class", "full").select("class", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("n_ref", "n_cls", "hit")])
    pa, ua = F.try_divide("hit", "n_ref"), F.try_divide("hit", "n_cls")
    return j.select("class", "n_ref", "n_cls", "hit", (pa * 100).alias("pa"), (F.sqrt(pa * (1 - pa) / F.col("n_ref")) * 100).alias("pa_se"), (ua * 100).alias("ua"), (F.sqrt(ua * (1 - ua) / F.col("n_cls")) * 100).alias("ua_se"))


def overall(m: DataFrame) -> DataFrame:
    """n, oa, its standard error (in %), kappa (0 where chance agreement is whole)."""
    t = by_class(m).agg(F.sum("n_ref").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("n_ref") * F.col("n_cls")).alias("e"))
    po, pe = F.col("hit") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return t.select("n", (po * 100).alias("oa"), (F.sqrt(po * (1 - po) / F.col("n")) * 100).alias("oa_se"), F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def difference(a: DataFrame, b: DataFrame, v: str = "v") -> DataFrame:
    """y, x, flag: 0 equal, 1 where a is larger (omission), 2 where it is smaller (commission), NULL where either is missing."""
    j = a.select("y", "x", F.col(v).alias("p")).join(b.select("y", "x", F.col(v).alias("q")), ["y", "x"], "full")
    return j.select("y", "x", F.when(F.col("p") == F.col("q"), 0).when(F.col("p") > F.col("q"), 1).when(F.col("p") < F.col("q"), 2).alias("flag"))


def identical(a: DataFrame, b: DataFrame, v: str = "v") -> DataFrame:
    """One row: n pixels, n that differ or are missing on one side."""
    d = difference(a, b, v)
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("flag").isNull() | (F.col("flag") > 0)).alias("n_different"))


def validate(points: DataFrame, grid: DataFrame, label: str, boundary: int = 1, homogeneous: bool = False, disc: bool = False) -> DataFrame:
    """id, ref, cls: samples with the class of the pixels around them (boundary cells wide); homogeneous keeps samples whose pixels agree; otherwise the most frequent class, the lowest on ties."""
    from .zonal import on_grid, point_cells

    cells = on_grid(point_cells(points, boundary // 2, disc), grid)
    votes = cells.groupBy("id", F.col("v").alias("k")).agg(F.count("*").alias("n"))
    won = votes.groupBy("id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("cls"), F.count("*").alias("kinds"))
    won = won.where("kinds = 1") if homogeneous else won
    # points have no bound, so they are not broadcast either
    return points.select("id", F.col(label).alias("ref")).join(won.select("id", "cls").hint("merge"), "id")


def extract_samples(classes: DataFrame, bands: DataFrame, keep: list | None = None) -> DataFrame:
    """Pixels of a class map with the bands of another raster: one sample each."""
    c = classes.where(F.col("v").isin(keep)) if keep else classes
    return c.where("v is not null").join(bands, ["y", "x"])
