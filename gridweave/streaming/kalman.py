"""State-space filtering of a stream of observations: one small state a pixel, by applyInPandasWithState."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kalman import Options, advance

OUT = "pixel long, t int, x double, p double"


def _update(o: Options):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, p, before = state.get if state.exists else (None, 0.0, None)
        first, rows = not state.exists, []
        one = lambda v: np.array([np.nan if v is None else v], float)
        for t, z, m in pd.concat(list(batches)).sort_values("t")[["t", "z", "m"]].itertuples(index=False):
            got = advance(o, np.array([first]), one(x), one(p), one(before), one(m), one(z), one(z), one(0.0), one(0.0))
            x, p, before, first = float(got[0][0]), float(got[1][0]), float("nan") if m is None else float(m), False
            rows.append((key[0], int(t), None if np.isnan(x) else x, p))
        state.update((x, p, before))
        yield pd.DataFrame(rows, columns=["pixel", "t", "x", "p"])

    return run


def filtered(stream: DataFrame, **options) -> DataFrame:
    """pixel, t, x, p as rows (pixel long, t int, z double, m double: the model's value) arrive; those of one batch are taken in order of t. options: of kalman.Options."""
    s = stream if "m" in stream.columns else stream.withColumn("m", F.lit(None).cast("double"))
    return s.groupBy("pixel").applyInPandasWithState(_update(Options(**options)), OUT, "x double, p double, before double", "append", "NoTimeout")


def running_composite(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Mean and count of v by (y, x) and window of event time ts; rows later than the watermark are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "y", "x").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
