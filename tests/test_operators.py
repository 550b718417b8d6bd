"""Hand-made cases of operators that SQL does not cover, and of options and quirks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import composite, focal, grid, kalman, learn, local, profile, regions, sample, zonal
from gridweave.sources import raster


def raster_of(spark, rows):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "y int, x int, v double")


def array_of(df, h, w):
    a = np.full((h, w), np.nan)
    for r in df.collect():
        if 0 <= r["y"] < h and 0 <= r["x"] < w and r["v"] is not None:
            a[r["y"], r["x"]] = r["v"]
    return a


def test_focal_mean_mirrors_and_skips_nodata(spark):
    rows = [[1, 2, 3], [4, None, 6], [7, 8, 9]]
    got = array_of(focal.focal(raster_of(spark, rows), "mean", 3, 3), 3, 3)
    a = np.pad(np.array([[np.nan if v is None else v for v in r] for r in rows], float), 1, mode="reflect")
    want = np.array([[np.nanmean(a[i : i + 3, j : j + 3]) for j in range(3)] for i in range(3)])
    assert np.allclose(got, want)


def test_round_trip_of_quadrants(spark):
    g = raster_of(spark, np.arange(64).reshape(8, 8).tolist())
    full = grid.Grid(0, 8, 1, 1, 8, 8)
    out = None
    for uly, ulx in ((8, 0), (8, 4), (4, 0), (4, 4)):
        q = grid.crop(g, full, grid.Grid(ulx, uly, 1, 1, 4, 4), ["v"]).select((F.col("y") + (8 - uly)).cast("int").alias("y"), (F.col("x") + ulx).cast("int").alias("x"), "v")
        out = q if out is None else out.unionByName(q)
    assert out.exceptAll(g).count() == 0 and out.count() == 64


def test_regions_and_sieve(spark):
    rows = [[1, 1, 2, 2], [1, 3, 2, 2], [1, 1, 2, 1], [1, 1, 2, 1]]
    g = raster_of(spark, rows)
    r = {(x["y"], x["x"]): x["region"] for x in regions.regions(g).collect()}
    assert len(set(r.values())) == 4 and r[0, 0] == r[3, 1] == 0 and r[2, 3] == r[3, 3]
    s = array_of(regions.sieve(g, 3), 4, 4)
    assert s[1, 1] == 1 and s[2, 3] == 2 and s[0, 3] == 2
    p = {x["region"]: x for x in regions.polygonize(g).collect()}
    assert p[0]["n"] == 7 and len(p[1 * (1 << 31) + 1]["edges"]) == 4


def test_polygon_cells(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    z = spark.createDataFrame([(1, [dict(x=x, y=y) for x, y in ring])], "fid int, ring array<struct<x:double,y:double>>")
    assert {(r["y"], r["x"]) for r in zonal.cells_of(z, 10, 10).collect()} == {(y, x) for y in range(4) for x in range(4) if x + y + 1 < 4}


def test_wavelets_invert():
    a = np.random.default_rng(0).normal(size=16)
    for family in profile.WAVELETS:
        assert np.allclose(profile.dwt(profile.dwt(a, family), family, True), a)
    b = np.random.default_rng(1).normal(size=(6, 4))
    assert np.allclose(focal.haar2d(focal.haar2d(b), True), b)


def test_splines_pass_through_their_points():
    x, y = np.arange(7.0), np.array([1.0, 3, 2, 5, 4, 4, 1])
    for kind in ("linear", "polynomial", "cspline", "cspline_periodic", "akima", "akima_periodic"):
        assert np.allclose(profile.spline_values(x, y, x, kind), y)
    assert np.allclose(profile.spline_values(x, 2 * x + 1, np.array([0.5, 3.25]), "akima"), [2.0, 7.5])


def test_savgol_keeps_parabolas():
    t = profile.savgol_taps(3, 3, 2)
    x = np.arange(-3, 4)
    assert np.isclose(np.dot(t, 2 * x * x + x + 5), 5) and np.isclose(np.dot(profile.savgol_taps(3, 3, 2, 1), 3 * x + 1), 3)


def test_kalman_by_hand(spark):
    rows = [(1, 0, 4.0, 2.0, 5.0, 3.0), (1, 1, None, 4.0, None, None), (1, 2, 5.0, 2.0, 4.0, 1.0), (1, 3, 6.0, None, 6.0, 0.0), (2, 0, 9.0, None, 9.0, 0.0), (2, 1, None, 3.0, None, None), (3, 0, None, None, None, None), (3, 1, None, 2.0, None, None)]
    s = spark.createDataFrame(rows, "pixel int, t int, z double, m double, mean double, var double")
    got = {(r["pixel"], r["t"]): (r["x"], r["p"], r["k"]) for r in kalman.kalman(s).collect()}
    # first: gain 3 / (3 + (5 - 2)^2), from the model; the uncertainty stays
    assert got[1, 0] == pytest.approx((2.5, 1.0, 0.25))
    assert got[1, 1] == pytest.approx((5.0, 4.0, 0.0))  # times 4 / 2
    # times 2 / 4: 2.5 and 1; then the gain is 1 / (1 + (4 - 2)^2)
    assert got[1, 2] == pytest.approx((3.0, 0.8, 0.2))
    assert got[1, 3] == pytest.approx((3.0, 1.8, 1.0))  # no model: kept, and no update
    assert got[2, 0] == pytest.approx((9.0, 1.0, 1.0)) and got[2, 1] == pytest.approx((9.0, 2.0, 0.0))
    assert got[3, 0] == (None, 100.0, 0.0) and got[3, 1] == pytest.approx((2.0, 1.0, 0.0))
    held = {(r["pixel"], r["t"]): r["x"] for r in kalman.kalman(s, low=2.2, high=4.5).collect()}
    assert held[1, 1] == 4.5 and held[1, 2] >= 2.2 and held[2, 0] == 4.5
    both = {(r["pixel"], r["t"]): (r["x"], r["p"]) for r in kalman.kalman(s, direction="smooth").where("pixel = 3").collect()}
    assert both == {(3, 0): (2.0, 2.0), (3, 1): (2.0, 0.5)}


def test_kalman_windows(spark):
    rows = [(0, y, x, float(3 * y + x), 1.0) for y in range(3) for x in range(3)]
    got = {r["pixel"]: r for r in kalman.windowed(spark.createDataFrame(rows, "t int, y int, x int, z double, m double"), 3, 3, 3).collect()}
    assert got[4]["mean"] == 4.0 and got[4]["var"] == pytest.approx(60 / 9) and got[0]["mean"] == 2.0


def brute_pass(a, rise, limit):
    """The scan, cell by cell."""
    b, (h, w) = a.copy(), a.shape
    fold = lambda k, n: -k if k < 0 else 2 * (n - 1) - k if k >= n else k
    out = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            near = [b[fold(y + i, h), fold(x + j, w)] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
            out[y, x] = sum(b[y, x] - v > rise for v in near) <= limit
            if not out[y, x]:
                b[y, x] = sorted(near)[1]
    return out


def test_ground_passes_are_the_scan():
    a = np.random.default_rng(0).integers(0, 12, (7, 9)).astype(float)
    flips = {"nwse": np.s_[:, :], "nesw": np.s_[:, ::-1], "senw": np.s_[::-1, ::-1], "swne": np.s_[::-1, :]}
    for d, f in flips.items():
        assert (focal.ground_pass(a, 2.0, 2, 3, d) == brute_pass(a[f], 2.0, 2)[f]).all()
    flat = np.zeros((6, 6))
    flat[2:4, 2:4] = 9.0  # a house
    assert (focal.ground_mask(flat, (1.0,)) == (flat > 0)).all()


def test_line_features_by_hand():
    a = np.zeros((5, 7))
    a[2, 1:6] = 1.0  # a line to the east, five cells
    longest, at_l, shortest, at_s = focal.linear_features(a, 45.0, 10.0, 0.1)
    assert longest[2, 3] == 4 and at_l[2, 3] == 90 and shortest[2, 3] == 0 and at_s[2, 3] == 0
    assert longest[2, 1] == 4 and focal.linear_features(a, 45.0, 3.0, 0.1)[0][2, 1] == 2


def test_filters_of_ground(spark):
    rows = np.zeros((9, 9))
    rows[3:5, 3:5] = 8.0
    g = raster_of(spark, rows.tolist())
    for method in ("etew_min", "promorph", "open"):
        assert (array_of(focal.dem_filter(g, method, 9, 9, largest=5, rise=1.0, slope=0.1), 9, 9) == 0).all()
    kept = array_of(focal.dem_filter(g, "open", 9, 9, rise=10.0), 9, 9)
    assert (kept == rows).all()


def test_mixed_forest_and_priors_by_hand(spark):
    g = raster_of(spark, [[11, 11, 11], [12, 13, 13], [20, 20, 30]])
    assert array_of(focal.focal_mixed(g, 3, 3), 3, 3)[1, 1] == 11.0  # 6 of 9 forest; 3 of 4 pure ones broadleaf
    assert array_of(focal.focal_mixed(raster_of(spark, [[30, 30, 20], [30, 11, 20], [20, 12, 30]]), 3, 3), 3, 3)[1, 1] == 30.0
    p = {(r["y"], r["x"]): r["p0"] for r in focal.class_prior(raster_of(spark, [[1, 2, 5], [2, 1, 5], [5, 5, 1]]), 3, 3, [1.0, 2.0], [[0.0, 1.0], [0.5, 0.0]]).collect()}
    assert p[1, 1] == pytest.approx(np.exp(-2) / (np.exp(-2) + np.exp(-1)))  # two neighbours of class 2, two of class 1


def test_reference_pixel(spark):
    from gridweave.operators import stats

    full = raster_of(spark, np.ones((32, 32)).tolist())
    assert tuple(stats.reference_pixel(full, 0.0, 32.0).first()) == (16.0, 16.0) and tuple(stats.reference_pixel(full).first()) == (16.0, 17.0)


def test_zones_with_holes_touched_cells_and_centroids(spark):
    ring = lambda *p: [dict(x=float(x), y=float(y)) for x, y in p]
    outer, hole = ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0)), ring((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))
    z = spark.createDataFrame([(1, [outer, hole])], "fid int, rings array<array<struct<x:double,y:double>>>")
    assert {(r["y"], r["x"]) for r in zonal.cells_of(z, 8, 8).collect()} == {(y, x) for y in range(6) for x in range(6) if not (2 <= y < 4 and 2 <= x < 4)}
    t = spark.createDataFrame([(1, ring((0.2, 0.2), (3.8, 0.4), (3.8, 0.6), (0.2, 0.2)))], "fid int, ring array<struct<x:double,y:double>>")
    assert zonal.cells_of(t, 8, 8).count() < 4 and {(r["y"], r["x"]) for r in zonal.cells_of(t, 8, 8, True).collect()} == {(0, x) for x in range(4)}
    shape = spark.createDataFrame([(1, ring((0, 0), (9, 0), (9, 1), (1, 1), (1, 9), (0, 9), (0, 0)))], "fid int, ring array<struct<x:double,y:double>>")
    r = zonal.centroid_cells(shape).first()
    assert (r["y"], r["x"]) == (2, 2)


def test_sieve_goes_on_until_nothing_is_small(spark):
    g = raster_of(spark, [[1, 2, 3, 9, 9], [9, 9, 9, 9, 9]])
    assert (array_of(regions.sieve(g, 4), 2, 5) == 9).all()


def test_composite_weights_and_ties(spark):
    px = spark.createDataFrame([(1, 0, 0, 2.0, 1.0), (2, 0, 0, 2.0, 5.0), (3, 0, 0, 1.0, 9.0)], "scene int, y int, x int, b0 double, b1 double")
    first = composite.composite(px, ["b0", "b1"], "maxband").first()
    assert (first["b1"], first["seq"], first["n"]) == (1.0, 1, 3)
    assert composite.composite(px, ["b0"], "mean", weights={1: 0.75, 2: 1.5, 3: 0.75}).first()["b0"] == pytest.approx((1.5 + 3 + 0.75) / 3)
    assert composite.mode(px, "b0", weights={1: 1.0, 2: 1.0, 3: 3.0}).first()["v"] == 1.0


def test_set_mask_first_match_wins(spark):
    g = raster_of(spark, [[1, 2, 3]])
    m = raster_of(spark, [[5, 9]]).withColumnRenamed("v", "m")
    assert array_of(local.set_mask(g, ["v"], m, [(">", 4, 0.0), ("=", 9, 7.0)], ["y", "x"]), 1, 3).tolist() == [[0, 0, 3]]


def test_fill_linear(spark):
    d = spark.createDataFrame([([None, 1.0, None, None, 4.0, None],), ([None, None],)], "bands array<double>")
    got = [r[0] for r in d.select(profile.fill_linear("bands")).collect()]
    assert got == [[1, 1, 2, 3, 4, 4], [None, None]]


def test_svm_kinds_and_network():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(-1, 0.4, (40, 2)), rng.normal(1, 0.4, (40, 2)), rng.normal((3, -3), 0.4, (40, 2))]
    y = np.repeat([1, 2, 3], 40)
    for make in (learn.SVM, lambda: learn.SVM("nu_SVC", nu=0.2), lambda: learn.SVM(name="polynomial", coef0=1.0), lambda: learn.MLP((6,))):
        m = make().fit(x, y)
        assert (m.classes[m.probabilities(x).argmax(1)] == y).mean() > 0.95
    assert (learn.cross_validated(learn.SVM, x, y, 4) == y).mean() > 0.9
    t = x[:, 0] * 2 - x[:, 1]
    for m in (learn.SVM("epsilon_SVR").fit(x, t), learn.SVM("nu_SVR").fit(x, t)):
        assert np.corrcoef(m.decision(x), t)[0, 1] > 0.95
    assert np.corrcoef(learn.MLP((6,)).fit(x, t, classes=False).predict(x)[:, 0], t)[0, 1] > 0.95
    p = learn.combined([np.array([[0.8, 0.2]]), np.array([[0.6, 0.4]])], "product")
    assert np.allclose(p, [[0.48 / 0.56, 0.08 / 0.56]])


def test_feature_search_finds_the_best_pair():
    value = {0: 1.0, 1: 3.0, 2: 2.0, 3: 0.5}
    for method in ("SFS", "SFFS", "SBS", "BFS"):
        assert sorted(learn.select_features(lambda c: sum(value[i] for i in c), 4, 2, method)[0]) == [1, 2]


def test_balanced_and_capped_samples(spark):
    d = spark.createDataFrame([(i, "a" if i < 500 else "b") for i in range(505)], "id int, k string")
    assert {r["k"]: r["count"] for r in sample.at_most(d, "k", ["id"], 20).groupBy("k").count().collect()} == {"a": 20, "b": 5}
    assert {r["k"]: r["count"] for r in sample.balanced(d, "k", ["id"], 20).groupBy("k").count().collect()} == {"a": 20, "b": 20}


def test_binary_readers(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a.pgm").write_bytes(raster.encode_pgm(3, 4, a.tobytes()))
    got = raster.read_netpbm(spark, str(tmp_path / "a.pgm")).select("y", "x", F.col("bands")[0].alias("v"))
    assert (array_of(got, 3, 4) == a).all()
    b = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "b.raw").write_bytes(b.transpose(1, 0, 2).tobytes())
    got = raster.read_raw(spark, str(tmp_path / "b.raw"), 3, 4, 2, "Int16", "bil").select("y", "x", F.col("bands")[1].alias("v"))
    assert (array_of(got, 3, 4) == b[1]).all()


def test_las_reader(spark, tmp_path):
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<H", head, 105, 20)
    struct.pack_into("<I", head, 107, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    pts = b"".join(struct.pack("<3iHBBbBH", x, y, z, 7, 1 | 2 << 3, 2, -3, 0, 0) for x, y, z in ((0, 0, 100), (150, 250, 300)))
    (tmp_path / "p.las").write_bytes(bytes(head) + pts)
    got = raster.read_las(spark, str(tmp_path / "p.las")).orderBy("x").collect()
    assert (got[1]["x"], got[1]["y"], got[1]["z"], got[1]["return_no"], got[1]["n_returns"], got[1]["class"], got[1]["angle"]) == (101.5, 202.5, 3.0, 1, 2, 2, -3)


def test_text_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# note\n1 2 3\n4 5 6\n")
    assert array_of(raster.read_matrix(spark, str(tmp_path / "m.txt")), 2, 3).tolist() == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "c.txt").write_text("1;10\n#x\n2;20\n")
    assert sorted(tuple(r) for r in raster.read_columns(spark, str(tmp_path / "c.txt"), [1, 0], ";", scale=2.0).collect()) == [(20, 2), (40, 4)]
    pts = raster.read_points(spark, str(tmp_path / "c.txt"), 0, 1, {"n": (1, "int")}, ";").where("x is not null")
    assert [r["n"] for r in pts.orderBy("x").collect()] == [10, 20]


def test_write_and_read_pixels(spark, tmp_path):
    d = spark.createDataFrame([("a", y, x, [float(y * x)]) for y in range(5) for x in range(4)] + [("b", 0, 0, [1.0])], raster.PIXELS)
    raster.write_pixels(d, str(tmp_path / "px"))
    got = raster.read_pixels(spark, str(tmp_path / "px"), ["a"], (1, 2))
    assert got.count() == 8 and "PushedFilters: [IsNotNull(y)" in got._jdf.queryExecution().toString()
