"""State-space filtering of a pixel's time series with a model series and observations.

Estimate x with uncertainty p. Time update: x times the ratio of the model's value to the one before, p times its square plus q times the variance of the window's
estimates. Measurement update with an observation z: its variance r is uo times the squared difference of the window's mean observation
and the model's value (eps at least), the gain k = p / (p + r) (1 if that sum is eps or less), x + k (z - x), (1 - k) p. The first date starts from the model with
uncertainty um; its gain comes from q times the variance of the window's observations, and p stays. Without a model's value the observation itself starts
the series, with uncertainty uo, and later dates keep x while p grows by uo; no update needs a model's value that is not there. Without either there is no estimate, and
p is `unknown`. x, and p from above, are held within low and high. The backward pass is the same in reverse order; the smoother is the mean of both passes
weighted by the other's uncertainty, or whichever exists.

A series is one row of arrays, so its length is bounded by time, not by pixels; a batch of series advances one date at a time as numpy columns. NULL is nodata; a model's
value of zero has no ratio and counts as none for the date after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    q: float = 1.0
    um: float = 1.0
    uo: float = 1.0
    unknown: float = 100.0
    low: float | None = None
    high: float | None = None
    eps: float = 0.00001


def advance(o: Options, first, x, p, before, m, z, mean, var, spread):
    """(x, p, k) at a date from those at the date before; arrays, NaN: nodata. first: whether the series starts here; before: the model's value of the date
    before; mean, var: of the window's observations; spread: variance of the window's estimates before."""
    m_ok, z_ok, x_ok = ~np.isnan(m), ~np.isnan(z), ~np.isnan(x) & ~first

    def held(x, p):
        x = x if o.low is None else np.fmax(x, np.where(np.isnan(x), np.nan, o.low))
        return (x, p) if o.high is None else (np.fmin(x, np.where(np.isnan(x), np.nan, o.high)), np.minimum(p, o.high))

    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = m / before
        steady = np.isfinite(ratio)
        moved = np.where(steady, x * ratio, x)
        grown = np.where(steady, p * ratio * ratio + o.q * spread, p + o.uo)
        fresh = np.where(m_ok, m, np.where(first, z, np.nan))
        doubt = np.where(m_ok, o.um, np.where(first & z_ok, o.uo, o.unknown))
        none = ~x_ok & np.isnan(fresh)
        x, p = held(np.where(x_ok, moved, fresh), np.where(x_ok, grown, doubt))
        p = np.where(none, o.unknown, p)
        update = z_ok & m_ok
        r = o.uo * (mean - m) ** 2
        prior = np.where(first, o.q * var, p)
        r = np.where(first, r, np.maximum(r, o.eps))
        k = np.where(prior + r > o.eps, prior / (prior + r), 1.0)
        x, p = held(np.where(update, x + k * (z - x), x), np.where(update & ~first, p * (1 - k), p))
        p = np.where(none, o.unknown, p)
    return x, p, np.where(update, np.minimum(k, 1.0), np.where(z_ok, 1.0, 0.0))


def _filtered(o: Options, backward: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {c: b.column(b.schema.get_field_index(c)) for c in ("z", "m", "mean", "var", "spread")}
            offsets = lists["z"].offsets.to_numpy()
            size = np.diff(offsets)
            n, t = b.num_rows, int(size.max(initial=0))
            place = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
            row = np.repeat(np.arange(n), size)
            if backward:
                place = size[row] - 1 - place
            a = {}
            for c, v in lists.items():
                a[c] = np.full((t, n), np.nan)
                a[c][place, row] = v.flatten().to_numpy(zero_copy_only=False)
            out = np.empty((3, t, n))
            x, p = np.full(n, np.nan), np.zeros(n)
            for i in range(t):
                before = a["m"][i - 1] if i else np.full(n, np.nan)
                x, p, k = advance(o, np.full(n, i == 0), x, p, before, a["m"][i], a["z"][i], a["mean"][i], a["var"][i], a["spread"][i])
                out[:, i] = x, p, k
            got = [pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(v[place, row], from_pandas=True)) for v in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *got], ["by", "t", "x", "p", "k"])

    return run


def kalman(series: DataFrame, by: str = "pixel", q: float = 1.0, um: float = 1.0, uo: float = 1.0, unknown: float = 100.0, low: float | None = None, high: float | None = None, eps: float = 0.00001, direction: str = "forward") -> DataFrame:
    """by, t, x, p, k for each row of series (by, t, z, m), one a date. direction: forward, backward or smooth. Columns mean and var hold the mean and variance of
    the observations in a window around the pixel, spread that of the estimates before; without them the window is the pixel itself (z, 0 and 0)."""
    o = Options(q, um, uo, unknown, low, high, eps)
    have = set(series.columns)
    value = lambda c, other: F.coalesce(F.col(c).cast("double"), other) if c in have else other
    z, zero = F.col("z").cast("double"), F.lit(0.0)
    row = F.struct(F.col("t").cast("int").alias("t"), z.alias("z"), F.col("m").cast("double").alias("m"), value("mean", z).alias("mean"), value("var", zero).alias("var"), value("spread", zero).alias("spread"))
    s = series.groupBy(F.col(by).alias("by")).agg(F.sort_array(F.collect_list(row)).alias("s")).select("by", *[F.col("s")[c].alias(c) for c in ("t", "z", "m", "mean", "var", "spread")])
    kind = f"by {dict(series.dtypes)[by]}, t array<int>, x array<double>, p array<double>, k array<double>"
    one = lambda backward: s.mapInArrow(_filtered(o, backward), kind).select("by", F.explode(F.arrays_zip("t", "x", "p", "k")).alias("o")).select(F.col("by").alias(by), "o.*")
    if direction in ("forward", "backward"):
        return one(direction == "backward")
    a, b = one(False), one(True).select(by, "t", F.col("x").alias("x2"), F.col("p").alias("p2"))
    total = F.col("p") + F.col("p2")
    some = F.col("x").isNotNull() & F.col("x2").isNotNull()
    x = F.when(some & (total < eps), (F.col("x") + F.col("x2")) / 2).when(some, (F.col("x") * F.col("p2") + F.col("x2") * F.col("p")) / total).otherwise(F.coalesce("x", "x2"))
    p = F.when(some & (total < eps), F.lit(eps)).when(some, F.col("p") * F.col("p2") / total).when(F.col("x").isNotNull(), F.col("p")).when(F.col("x2").isNotNull(), F.col("p2")).otherwise(F.lit(unknown))
    if low is not None:
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    if high is not None:
        x, p = F.when(x.isNotNull(), F.least(x, F.lit(high))), F.least(p, F.lit(high))
    return a.join(b, [by, "t"]).select(by, "t", x.alias("x"), p.alias("p"), "k")


def windowed(pixels: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """pixel, t, z, m, mean, var from rows (t, y, x, z, m) of all dates: the statistics of the observations in size x size windows, cut at the edges."""
    from .focal import offsets

    k = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets(size)])
    sent = pixels.where("z is not null").select("t", "z", F.explode(k).alias("k"), "y", "x").select("t", "z", (F.col("y") + F.col("k.i")).alias("y"), (F.col("x") + F.col("k.j")).alias("x"))
    stats = sent.groupBy("t", "y", "x").agg(F.avg("z").alias("mean"), F.var_pop("z").alias("var"))
    return pixels.join(stats, ["t", "y", "x"], "left").select((F.col("y").cast("long") * width + F.col("x")).alias("pixel"), "t", "z", "m", "mean", "var")
