"""Spectral and temporal filters along a pixel's bands (ARRAY<DOUBLE>): array expressions in the JVM, no shuffle.

Splines and wavelets, which arrays cannot express, run as Arrow-batched pandas functions; linear filling, for which they would take the square of the bands, on Arrow arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Low-pass filter taps of the wavelet families.
WAVELETS = {"haar": [2**-0.5, 2**-0.5], "daubechies4": [0.4829629131445341, 0.8365163037378079, 0.2241438680420134, -0.1294095225512604]}


def _valid(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def _var(a: Column) -> Column:
    n = F.size(a)
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) - _sum(a) * _sum(a) / F.nullif(n, F.lit(0)), n)


def _percentile(a: Column, p: float) -> Column:
    s = F.sort_array(a)
    at = (F.size(a) - 1) * (p / 100)
    lo = F.floor(at).cast("int")
    return F.when(F.size(a) > 0, F.get(s, lo) + (F.coalesce(F.get(s, lo + 1), F.get(s, lo)) - F.get(s, lo)) * (at - lo))


#: Statistics of the valid members of an array.
STATS = {
    "first": lambda a, **_: F.get(a, F.lit(0)), "last": lambda a, **_: F.get(a, F.size(a) - 1), "nvalid": lambda a, **_: F.size(a).cast("double"), "min": lambda a, **_: F.array_min(a), "erode": lambda a, **_: F.array_min(a), "max": lambda a, **_: F.array_max(a), "dilate": lambda a, **_: F.array_max(a),
    "sum": lambda a, **_: _sum(a), "mean": lambda a, **_: _mean(a), "var": lambda a, **_: F.greatest(_var(a), F.lit(0.0)), "stdev": lambda a, **_: F.sqrt(F.greatest(_var(a), F.lit(0.0))), "median": lambda a, **_: _percentile(a, 50), "percentile": lambda a, p=95, **_: _percentile(a, p),
}


def stat(bands: str | Column, name: str, **options) -> Column:
    """One statistic of the whole profile."""
    return STATS[name](_valid(F.col(bands) if isinstance(bands, str) else bands), **options)


def moving(bands: str, name: str, dim: int, **options) -> Column:
    """The statistic over a window of dim bands around each band, shorter at the ends."""
    a, k = F.col(bands), dim // 2
    at = F.sequence(F.lit(0), F.size(a) - 1)

    def one(i: Column) -> Column:
        lo, hi = F.greatest(i - k, F.lit(0)), F.least(i + k, F.size(a) - 1)
        return STATS[name](_valid(F.slice(a, (lo + 1).cast("int"), (hi - lo + 1).cast("int"))), **options)

    return F.transform(at, one)


def padded_index(i: Column, n: Column, padding: str) -> Column:
    """A place beyond the ends by rule; for zero padding it stays outside."""
    if padding == "symmetric":
        return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)
    if padding == "replicate":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if padding == "circular":
        return F.pmod(i, n)
    return i


def fir(bands: str, taps: list[float], padding: str = "symmetric", normalize: bool = True) -> Column:
    """Dot product of the taps, centred, with each band's surroundings; taps are divided by their sum unless it is nearly zero."""
    total = sum(taps)
    taps = [t / total for t in taps] if normalize and abs(total) > 1e-9 else list(taps)
    a, n, k = F.col(bands), F.size(F.col(bands)), len(taps) // 2

    def one(i: Column) -> Column:
        out = None
        for j, t in enumerate(taps):
            at = padded_index(i + (j - k), n, padding)
            v = F.when((at >= 0) & (at < n), F.get(a, at)).otherwise(0.0) * t
            out = v if out is None else out + v
        return out

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def smooth(bands: str, dim: int, padding: str = "symmetric") -> Column:
    return fir(bands, [1.0] * dim, padding)


def savgol_taps(left: int, right: int, degree: int, derivative: int = 0) -> list[float]:
    """Least-squares polynomial weights over left + 1 + right bands."""
    x = np.arange(-left, right + 1)
    a = np.vander(x, degree + 1, increasing=True)
    return (np.linalg.pinv(a)[derivative] * float(np.prod(np.arange(1, derivative + 1)))).tolist()


def savgol(bands: str, left: int, right: int, degree: int, derivative: int = 0, padding: str = "replicate") -> Column:
    if left != right:
        raise ValueError("a symmetric window is needed")
    return fir(bands, savgol_taps(left, right, degree, derivative), padding, normalize=False)


def fill_linear(bands: str) -> Column:
    """NULL bands by linear interpolation between their valid neighbours; the ends repeat the nearest."""

    @F.arrow_udf("array<double>")
    def run(a: pa.Array) -> pa.Array:
        # one pass over the bands of a batch: places of the last valid band before each, and of the next after it
        many, flat = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), a.flatten().cast(pa.float64())
        ends = np.cumsum(many, dtype=np.int64)
        i, end = np.arange(len(flat)), np.repeat(ends, many)
        start = np.repeat(ends - many, many)
        valid, v = flat.is_valid().to_numpy(zero_copy_only=False), flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        lo = np.maximum.accumulate(np.where(valid, i, -1))
        hi = np.minimum.accumulate(np.where(valid, i, len(flat))[::-1])[::-1]
        before, after = lo >= start, hi < end
        lo, hi = np.where(before, lo, np.where(after, hi, i)), np.where(after, hi, np.where(before, lo, i))
        with np.errstate(invalid="ignore", over="ignore"):
            out = np.where(lo == hi, v[lo], v[lo] + (v[hi] - v[lo]) * (i - lo) / np.maximum(hi - lo, 1))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(out, mask=~(before | after)), mask=a.is_null())

    return run(F.col(bands))


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """linear, polynomial, cspline (natural), cspline_periodic, akima, akima_periodic through (x, y); ends repeat outside."""
    at = np.clip(at, x[0], x[-1])
    n = len(x)
    if n == 1 or kind == "linear" or n == 2:
        return np.interp(at, x, y)
    if kind == "polynomial":
        return np.polynomial.polynomial.Polynomial.fit(x, y, n - 1)(at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[k]
    if kind.startswith("cspline"):
        m = np.zeros((n, n))
        r = np.zeros(n)
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            r[i] = 6 * (d[i] - d[i - 1])
        if kind.endswith("periodic"):
            m[0, 0], m[0, -1] = 1, -1
            m[-1, 0], m[-1, 1], m[-1, -2], m[-1, -1] = 2 * h[0], h[0], h[-1], 2 * h[-1]
            r[-1] = 6 * (d[0] - d[-1])
        else:
            m[0, 0] = m[-1, -1] = 1
        s = np.linalg.solve(m, r)
        return y[k] + u * (d[k] - h[k] * (2 * s[k] + s[k + 1]) / 6) + u**2 * s[k] / 2 + u**3 * (s[k + 1] - s[k]) / (6 * h[k])
    ext = np.r_[d[-2:], d, d[:2]] if kind.endswith("periodic") else np.r_[3 * d[0] - 2 * d[1], 2 * d[0] - d[1], d, 2 * d[-1] - d[-2], 3 * d[-1] - 2 * d[-2]]
    w1, w2 = np.abs(ext[3:] - ext[2:-1]), np.abs(ext[1:-2] - ext[:-3])
    t = np.where(w1 + w2 > 1e-12, (w1 * ext[1:-2] + w2 * ext[2:-1]) / np.maximum(w1 + w2, 1e-300), (ext[1:-2] + ext[2:-1]) / 2)
    return y[k] + u * t[k] + u**2 * (3 * d[k] - 2 * t[k] - t[k + 1]) / h[k] + u**3 * (t[k] + t[k + 1] - 2 * d[k]) / h[k] ** 2


def _mapped(f) -> object:
    @F.pandas_udf("array<double>")
    def run(bands: pd.Series) -> pd.Series:
        return bands.map(lambda a: None if a is None else f(np.array(a, float)).tolist())

    return run


def fill_spline(bands: str, kind: str) -> Column:
    def one(a: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(a)
        return a if not ok.any() else np.where(ok, a, spline_values(np.flatnonzero(ok).astype(float), a[ok], np.arange(len(a), dtype=float), kind))

    return _mapped(one)(F.col(bands))


def dwt(a: np.ndarray, family: str = "haar", inverse: bool = False) -> np.ndarray:
    """Full periodic wavelet transform; the length is padded to a power of two by repeating the last value."""
    low = np.array(WAVELETS[family])
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    n = 1 << max(0, int(np.ceil(np.log2(max(1, len(a))))))
    out = np.r_[a, np.full(n - len(a), a[-1] if len(a) else 0.0)].astype(float)
    sizes = [n >> i for i in range(int(np.log2(n)))] if n > 1 else []
    for m in reversed(sizes) if inverse else sizes:
        at = (2 * np.arange(m // 2)[:, None] + np.arange(len(low))) % m
        if inverse:
            part = np.zeros(m)
            np.add.at(part, at, out[: m // 2, None] * low + out[m // 2 : m, None] * high)
            out[:m] = part
        else:
            out[:m] = np.r_[out[:m][at] @ low, out[:m][at] @ high]
    return out


def wavelet(bands: str, family: str = "haar", mode: str = "forward", cut: float = 0.0) -> Column:
    """forward; inverse; cut: back from coefficients of which the smallest `cut` percent are zeroed; cut_from: all from place `cut` on are."""

    def one(a: np.ndarray) -> np.ndarray:
        if mode in ("forward", "inverse"):
            return dwt(a, family, mode == "inverse")
        c = dwt(a, family)
        if mode == "cut":
            c[np.argsort(np.abs(c), kind="stable")[: int(len(c) * cut / 100)]] = 0
        else:
            c[int(cut) :] = 0
        return dwt(c, family, True)[: len(a)]

    return _mapped(one)(F.col(bands))


def weighted(bands: str, weights: list[list[float]]) -> Column:
    """Each output band is a fixed weighted sum of the input bands."""
    a = F.col(bands)

    def one(row: list[float]) -> Column:
        out = F.lit(0.0)
        for i, w in enumerate(row):
            if w:
                out = out + F.get(a, F.lit(i)) * w
        return out

    return F.array(*[one(r) for r in weights])


def srf_weights(wavelengths: list[float], response: list[tuple[float, float]], step: float = 1.0) -> list[float]:
    """Weights of the input bands for one response function (wavelength, response), integrated on a grid of `step`; input bands are interpolated linearly."""
    w, r = np.array(response, float).T
    grid = np.arange(w[0], w[-1] + step / 2, step)
    s = spline_values(w, r, grid, "cspline")
    s = s / s.sum()
    basis = np.eye(len(wavelengths))
    return [float(np.interp(grid, wavelengths, basis[i]) @ s) for i in range(len(wavelengths))]


def fwhm_weights(wavelengths: list[float], centre: float, fwhm: float) -> list[float]:
    """Weights for a Gaussian response on a grid of one unit."""
    sigma = fwhm / (2 * np.sqrt(2 * np.log(2)))
    grid = np.arange(np.floor(wavelengths[0]), np.ceil(wavelengths[-1]) + 1)
    s = np.exp(-0.5 * ((grid - centre) / sigma) ** 2)
    s = s / s.sum()
    basis = np.eye(len(wavelengths))
    return [float(np.interp(grid, wavelengths, basis[i]) @ s) for i in range(len(wavelengths))]


def resample(bands: str, n: int, method: str = "linear") -> Column:
    """n values spread evenly over the profile, by linear interpolation or the nearest band."""
    a, m = F.col(bands), F.size(F.col(bands))

    def one(i: Column) -> Column:
        at = i * (m - 1) / float(max(1, n - 1))
        lo = F.floor(at).cast("int")
        if method == "near":
            return F.get(a, F.floor(at + 0.5).cast("int"))
        return F.get(a, lo) + (F.coalesce(F.get(a, lo + 1), F.get(a, lo)) - F.get(a, lo)) * (at - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def down(bands: str, factor: int) -> Column:
    """Means of runs of `factor` bands."""
    a = F.col(bands)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / factor).cast("int") - 1), lambda i: _mean(F.slice(a, i * factor + 1, F.lit(factor))))
