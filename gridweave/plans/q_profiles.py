"""Profile filters over the cube's 64 bands, and state-space filtering of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import kalman as K
from ..operators import profile as P
from ..registry import query
from . import fixtures as X

N = 64


def query_long(name: str, sql: str | None = None, keys: str = "y, x"):
    """Registers a query whose result has an array v as rows keys, b (place), v."""
    if sql:
        sql = f"SELECT {keys}, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS b, unnest(v) AS v FROM ({sql})"
    return lambda f: query(name, sql)(lambda s, d: f(s, d).select(*keys.split(", "), F.posexplode("v").alias("b", "v")))


def _rounded(c, n=6):
    return F.transform(c, lambda v: F.round(v, n))


def _listed(name: str, body: str, column, digits: int = 6) -> None:
    """body: SQL rows y, x, b, v."""
    sql = X.sql(X.CUBE, f"o AS ({body})", f"SELECT y, x, list(round(v + 1e-9, {digits}) + 0.0::DOUBLE ORDER BY b) AS v FROM o GROUP BY y, x")
    query_long(name, sql)(lambda s, d: X.cube(s, d).select("y", "x", F.transform(column(), lambda v: F.round(v + 1e-9, digits) + F.lit(0.0)).alias("v")))


_WIN = "SELECT y, x, b, {f} OVER (PARTITION BY y, x ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM cb"
for _m, _f in {"min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "median": "median(v)", "var": "var_pop(v)", "stdev": "stddev_pop(v)", "first": "first(v)", "last": "last(v)", "nvalid": "sum(1.0::DOUBLE)"}.items():
    _listed(f"o122_moving_{_m}", _WIN.format(f=_f), lambda m=_m: P.moving("bands", m, 5), 5)
_WHOLE = {"min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "round(avg(v), 5)", "median": "median(v)", "var": "round(var_pop(v) + 1e-9, 4)", "stdev": "round(stddev_pop(v) + 1e-9, 5)", "nvalid": "CAST(count(v) AS DOUBLE)"}
query("o123_profile_stats", X.sql(X.CUBE, "SELECT y, x, " + ", ".join(f"{f} AS {m}" for m, f in _WHOLE.items()) + ", round(quantile_cont(v, 0.9), 5) AS percentile FROM cb GROUP BY y, x"))(
    lambda s, d: X.cube(s, d).select("y", "x", *[(F.round(P.stat("bands", m) + (1e-9 if m in ("var", "stdev") else 0.0), 4 if m == "var" else 5) if "round" in f else P.stat("bands", m)).alias(m) for m, f in _WHOLE.items()], F.round(P.stat("bands", "percentile", p=90), 5).alias("percentile"))
)
query("o092_band_profile", X.sql(X.CUBE, "SELECT y, x, arg_min(v, b) AS first, arg_max(v, b) AS last, min(v) AS min, max(v) AS max, round(avg(v), 5) AS mean FROM cb GROUP BY y, x"))(
    lambda s, d: X.cube(s, d).select("y", "x", *[P.stat("bands", m).alias(m) for m in ("first", "last", "min", "max")], F.round(P.stat("bands", "mean"), 5).alias("mean"))
)
_AT = {"symmetric": "CASE WHEN {k} < 0 THEN -{k} WHEN {k} > 63 THEN 126 - {k} ELSE {k} END", "replicate": "least(63, greatest(0, {k}))", "circular": "({k} + 64) % 64", "zero": "{k}"}
for _pad, _at in _AT.items():
    _listed(f"o124_fir_{_pad}", "SELECT a.y, a.x, a.b, coalesce(sum(c.v * CASE WHEN j.d = 0 THEN 2 ELSE 1 END), 0) / 4 AS v FROM cb a CROSS JOIN range(-1, 2) j(d) LEFT JOIN cb c ON c.y = a.y AND c.x = a.x AND c.b = " + _at.format(k="(a.b + j.d)") + " GROUP BY a.y, a.x, a.b", lambda p=_pad: P.fir("bands", [1, 2, 1], p))
_listed("o125_smooth", "SELECT a.y, a.x, a.b, sum(c.v) / 5 AS v FROM cb a CROSS JOIN range(-2, 3) j(d) JOIN cb c ON c.y = a.y AND c.x = a.x AND c.b = " + _AT["symmetric"].format(k="(a.b + j.d)") + " GROUP BY a.y, a.x, a.b", lambda: P.smooth("bands", 5))
_GAP = "CASE WHEN b % 7 IN (3, 4) THEN NULL ELSE v END"


def _gaps():
    return F.transform("bands", lambda v, i: F.when(~(i % 7).isin(3, 4), v))


query_long("o126_fill_linear", X.sql(X.CUBE, f"w AS (SELECT y, x, b, {_GAP} AS v FROM cb)",
    "n AS (SELECT y, x, b, v, max(CASE WHEN v IS NOT NULL THEN b END) OVER p AS lo, min(CASE WHEN v IS NOT NULL THEN b END) OVER q AS hi FROM w WINDOW p AS (PARTITION BY y, x ORDER BY b), q AS (PARTITION BY y, x ORDER BY b DESC))",
    "SELECT n.y, n.x, list(round(CASE WHEN n.v IS NOT NULL THEN n.v ELSE l.v + (h.v - l.v) * (n.b - n.lo) / (n.hi - n.lo) END, 6) ORDER BY n.b) AS v FROM n JOIN w l ON l.y = n.y AND l.x = n.x AND l.b = n.lo JOIN w h ON h.y = n.y AND h.x = n.x AND h.b = n.hi GROUP BY n.y, n.x"))(
    lambda s, d: X.cube(s, d).select("y", "x", _gaps().alias("bands")).select("y", "x", _rounded(P.fill_linear("bands")).alias("v"))
)
for _k in ("polynomial", "cspline", "cspline_periodic", "akima", "akima_periodic"):
    if _k != "polynomial":  # the polynomial through 46 bands has no use at any precision
        query_long(f"o126_fill_{_k}")(lambda s, d, k=_k: X.cube(s, d).select("y", "x", _gaps().alias("bands")).select("y", "x", P.fill_spline("bands", k).alias("v")))
query_long("o126_fill_polynomial")(lambda s, d: X.cube(s, d).select("y", "x", F.slice(_gaps(), 1, 8).alias("bands")).select("y", "x", P.fill_spline("bands", "polynomial").alias("v")))
_SG = P.savgol_taps(3, 3, 2)
_listed("o127_savitzky_golay", "SELECT a.y, a.x, a.b, sum(c.v * CASE j.d " + " ".join(f"WHEN {i - 3} THEN {t!r}::DOUBLE" for i, t in enumerate(_SG)) + " END) AS v FROM cb a CROSS JOIN range(-3, 4) j(d) JOIN cb c ON c.y = a.y AND c.x = a.x AND c.b = " + _AT["replicate"].format(k="(a.b + j.d)") + " GROUP BY a.y, a.x, a.b", lambda: P.savgol("bands", 3, 3, 2), 5)
for _mode in ("forward", "cut", "cut_from"):
    for _fam in P.WAVELETS:
        query_long(f"o128_dwt_{_mode}_{_fam}")(lambda s, d, m=_mode, f=_fam: X.cube(s, d).select("y", "x", P.wavelet("bands", f, m, 16).alias("v")))
query_long("o128_dwt_round_trip_haar", X.sql(X.CUBE, "SELECT y, x, list(round(v, 4) ORDER BY b) AS v FROM cb GROUP BY y, x"))(lambda s, d: X.cube(s, d).select("y", "x", P.wavelet("bands").alias("c")).select("y", "x", _rounded(P.wavelet("c", mode="inverse"), 4).alias("v")))
_WL = [400.0 + 10 * i for i in range(N)]
_SRF = [P.srf_weights(_WL, [(430.0, 0.0), (450.0, 1.0), (470.0, 1.0), (490.0, 0.0)]), P.srf_weights(_WL, [(600.0, 0.1), (650.0, 1.0), (700.0, 0.1)])]
_FW = [P.fwhm_weights(_WL, 550.0, 40.0), P.fwhm_weights(_WL, 800.0, 60.0)]


def _sum_sql(rows):
    case = lambda r: "CASE b " + " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(r) if w) + " ELSE 0 END"
    return X.sql(X.CUBE, "SELECT y, x, " + ", ".join(f"round(sum(v * {case(r)}), 4) AS s{k}" for k, r in enumerate(rows)) + " FROM cb GROUP BY y, x")


for _name, _rows in (("o129_spectral_response", _SRF), ("o130_fwhm", _FW)):
    query(_name, _sum_sql(_rows))(lambda s, d, r=_rows: X.cube(s, d).select("y", "x", P.weighted("bands", r).alias("w")).select("y", "x", *[F.round(F.get("w", F.lit(k)), 4).alias(f"s{k}") for k in range(len(r))]))
query_long("o131_resample_up", X.sql(X.CUBE, "k AS (SELECT i, i * 63 / 126.0::DOUBLE AS at FROM range(127) t(i))", "SELECT a.y, a.x, list(round(a.v + (coalesce(c.v, a.v) - a.v) * (k.at - floor(k.at)), 6) ORDER BY k.i) AS v FROM k JOIN cb a ON a.b = floor(k.at) LEFT JOIN cb c ON c.y = a.y AND c.x = a.x AND c.b = a.b + 1 GROUP BY a.y, a.x"))(
    lambda s, d: X.cube(s, d).select("y", "x", _rounded(P.resample("bands", 127)).alias("v"))
)
query_long("o131_resample_near", X.sql(X.CUBE, "k AS (SELECT i, floor(i * 63 / 20.0::DOUBLE + 0.5::DOUBLE) AS at FROM range(21) t(i))", "SELECT y, x, list(v ORDER BY k.i) AS v FROM k JOIN cb ON b = k.at GROUP BY y, x"))(lambda s, d: X.cube(s, d).select("y", "x", P.resample("bands", 21, "near").alias("v")))
query_long("o131_resample_down", X.sql(X.CUBE, "m AS (SELECT y, x, b // 4 AS k, round(avg(v), 6) AS v FROM cb GROUP BY ALL)", "SELECT y, x, list(v ORDER BY k) AS v FROM m GROUP BY y, x"))(lambda s, d: X.cube(s, d).select("y", "x", _rounded(P.down("bands", 4)).alias("v")))
query_long("o132_filter_columns", keys="k", sql="WITH w AS (SELECT o_custkey AS k, row_number() OVER p AS b, round(avg(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS v FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT k, list(v ORDER BY b) AS v FROM w GROUP BY k")(
    lambda s, d: X.table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").cast("double").alias("v")))), lambda r: r["v"]).alias("bands")).select("k", _rounded(P.moving("bands", "mean", 3), 4).alias("v"))
)


# --- state space --------------------------------------------------------------------------------------------------


def _observed(s, d):
    """Every second day is observed; the model is a fixed season."""
    return X.series(s, d).select("pixel", "t", F.when(F.col("t") % 2 == 0, F.col("v")).alias("z"), (F.col("t") % 7 + 1).cast("double").alias("m"))


def _recursion(name: str, order: str) -> str:
    """The filter over a window of one pixel, as recursive SQL: time update (xp, pp), then the gain."""
    return f"""ob_{name} AS (SELECT pixel, t, CASE WHEN t % 2 = 0 THEN v END AS z, CAST(t % 7 + 1 AS DOUBLE) AS m, row_number() OVER (PARTITION BY pixel ORDER BY t {order}) AS i FROM se),
  {name} AS (SELECT pixel, i, t, m, CASE WHEN z IS NULL OR (z - m) * (z - m) > 0.00001::DOUBLE THEN m ELSE z END AS x, 1.0::DOUBLE AS p FROM ob_{name} WHERE i = 1
  UNION ALL SELECT pixel, i, t, m, CASE WHEN z IS NULL THEN xp ELSE xp + pp / (pp + r) * (z - xp) END, CASE WHEN z IS NULL THEN pp ELSE pp * (1 - pp / (pp + r)) END
  FROM (SELECT o.pixel, o.i, o.t, o.m, o.z, b.x * (o.m / b.m) AS xp, b.p * (o.m / b.m) * (o.m / b.m) AS pp, greatest((o.z - o.m) * (o.z - o.m), 0.00001::DOUBLE) AS r FROM {name} b JOIN ob_{name} o ON o.pixel = b.pixel AND o.i = b.i + 1))"""


for _dir, _o in (("forward", ""), ("backward", "DESC")):
    query(f"o163_kalman_{_dir}", "WITH RECURSIVE " + X.SERIES + ", " + _recursion("r", _o) + " SELECT pixel, t, round(x, 6) AS x, round(p, 6) AS p FROM r")(
        lambda s, d, k=_dir: K.kalman(_observed(s, d), direction=k).select("pixel", "t", F.round("x", 6).alias("x"), F.round("p", 6).alias("p"))
    )
query("o163_kalman_smooth", "WITH RECURSIVE " + X.SERIES + ", " + _recursion("r", "") + ", " + _recursion("rb", "DESC") + " SELECT r.pixel, r.t, round(CASE WHEN r.p + rb.p < 0.00001::DOUBLE THEN (r.x + rb.x) / 2 ELSE (r.x * rb.p + rb.x * r.p) / (r.p + rb.p) END, 6) AS x, round(CASE WHEN r.p + rb.p < 0.00001::DOUBLE THEN 0.00001::DOUBLE ELSE r.p * rb.p / (r.p + rb.p) END, 6) AS p FROM r JOIN rb ON r.pixel = rb.pixel AND r.t = rb.t")(
    lambda s, d: K.kalman(_observed(s, d), direction="smooth").select("pixel", "t", F.round("x", 6).alias("x"), F.round("p", 6).alias("p"))
)
