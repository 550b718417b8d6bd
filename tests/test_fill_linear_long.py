"""Linear filling takes time in proportion to the bands, and keeps what is no gap."""

import math
import time

import numpy as np

from gridweave.operators import profile


def test_long_profiles(spark):
    r = np.random.default_rng(2)
    rows = [[None if r.random() < 0.4 else float(r.integers(100)) for _ in range(2000)] for _ in range(8)]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "id int, bands array<double>").repartition(2)
    t = time.time()
    got = {x["id"]: x["v"] for x in d.select("id", profile.fill_linear("bands").alias("v")).collect()}
    assert time.time() - t < 30
    for i, b in enumerate(rows):
        at = [k for k, v in enumerate(b) if v is not None]
        assert np.allclose(got[i], np.interp(range(2000), at, [b[k] for k in at]), rtol=0, atol=1e-9)


def test_what_is_no_gap(spark):
    rows = [None, [], [None], [None, None, 3.0], [math.nan, None, 1.0], [1.0, None, math.inf], [5.0], [None, None]]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in rows], "bands array<double>").coalesce(1).select(profile.fill_linear("bands")).collect()]
    assert got[:4] == [None, [], [None], [3, 3, 3]] and got[5:] == [[1, math.inf, math.inf], [5], [None, None]]
    assert math.isnan(got[4][0]) and math.isnan(got[4][1]) and got[4][2] == 1
