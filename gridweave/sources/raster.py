"""Readers and writers: rasters, text, point clouds.

A raster on disk becomes rows (scene, y, x, bands); parquet is the engine's own form, partitioned by scene, so that
filters on scene and ranges of y reach the scan. Foreign formats are read as binary files and decoded by Arrow-batched functions, one file a row.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numpy codes and ranges of pixel types.
TYPES = {"Byte": "u1", "UInt16": "u2", "Int16": "i2", "UInt32": "u4", "Int32": "i4", "Float32": "f4", "Float64": "f8"}
SPARK_TYPES = {"Byte": "short", "UInt16": "int", "Int16": "short", "UInt32": "long", "Int32": "int", "Float32": "float", "Float64": "double"}
PIXELS = "scene string, y int, x int, bands array<double>"


def read_pixels(spark: SparkSession, path: str, scenes: list | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """The engine's own parquet; scenes and rows are pushed to the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("scene").isin(scenes)) if scenes else df
    return df.where(F.col("y").between(*rows)) if rows else df


def write_pixels(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a scene, rows in order within each file, so that row groups prune by y. A scene of any size is dealt over bands of rows."""
    df.repartition("scene", F.floor(F.col("y") / 1024)).sortWithinPartitions("scene", "y", "x").write.mode(mode).partitionBy("scene").parquet(path)


def new_raster(spark: SparkSession, height: int, width: int, values: list[float] | None = None, seed: int | None = None, uniform: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """y, x, bands: constant bands, or one of uniform draws by cell."""
    from ..operators.sample import chance

    d = spark.range(height * width).select("id", F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    bands = F.array(*[F.lit(float(v)) for v in values]) if values else F.array(chance(["id"], seed or 1) * (uniform[1] - uniform[0]) + uniform[0])
    return d.select("y", "x", bands.alias("bands"))


def cast_type(v: Column, kind: str) -> Column:
    """A value as a pixel type holds it: whole types truncate and saturate."""
    if kind not in TYPES:
        raise ValueError(f"unknown pixel type {kind}")
    if kind.startswith("Float"):
        return v.cast(SPARK_TYPES[kind])
    bits, signed = int(TYPES[kind][1]) * 8, TYPES[kind][0] == "i"
    lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v.cast("long"))).cast(SPARK_TYPES[kind])


# --- text ---------------------------------------------------------------------------------------------------------


def read_matrix(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """y, x, v of text matrices, one line a row, fields apart by blanks. Line numbers come from the whole file, so a file is read by one task."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda r: (F.trim(r) != "") & ~F.ltrim(r).startswith(comment)).alias("rows"))
    t = t.select(F.posexplode("rows").alias("y", "r")).select("y", F.posexplode(F.split(F.trim("r"), r"[\s,;]+")).alias("x", "v"))
    return t.select("y", "x", F.col("v").try_cast("double").alias("v"))


def read_columns(spark: SparkSession, path: str, columns: list[int], sep: str | None = None, comment: str = "#", scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """c0, c1, ...: chosen columns of delimited text, scaled."""
    t = spark.read.text(path).where(~F.ltrim("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), f"\\Q{sep}\\E" if sep else r"\s+")
    return t.select(*[(F.get(parts, F.lit(c)).try_cast("double") * scale + offset).alias(f"c{i}") for i, c in enumerate(columns)])


def read_points(spark: SparkSession, path: str, x: int = 0, y: int = 1, fields: dict | None = None, sep: str = ",") -> DataFrame:
    """x, y and named, typed fields {name: (column, type)} of delimited text; what is not of its type is NULL."""
    t = spark.read.text(path)
    p = F.split("value", f"\\Q{sep}\\E")
    return t.select(F.get(p, F.lit(x)).try_cast("double").alias("x"), F.get(p, F.lit(y)).try_cast("double").alias("y"), *[F.get(p, F.lit(c)).try_cast(k).alias(n) for n, (c, k) in (fields or {}).items()])


def as_polygon(points: DataFrame, order: str, by: str) -> DataFrame:
    """fid, ring: each group's points in order, closed."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct(order, "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.groupBy(F.col(by).alias("fid")).agg(ring.alias("ring")).select("fid", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))


def dump_matrix(g: DataFrame, nodata: str = "nan") -> DataFrame:
    """y, line: a raster's rows as text, columns in order."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("x", F.coalesce(F.col("v").cast("string"), F.lit(nodata)).alias("s")))), lambda c: c["s"])
    return g.groupBy("y").agg(F.concat_ws(" ", cells).alias("line"))


def dump_list(g: DataFrame) -> DataFrame:
    """x, y, v of valid pixels."""
    return g.where("v is not null").select("x", "y", "v")


def transposed(df: DataFrame, key: str) -> DataFrame:
    """field, and one column for each key (few): features as columns."""
    cols = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(key, cols, "field", "value")
    return long.groupBy("field").pivot(key).agg(F.first("value"))


# --- binary rasters and point clouds ------------------------------------------------------------------------------


def _decoded(raw: bytes) -> tuple:
    """(height, width, bands as arrays) of a portable grey or pixel map."""
    import re

    import numpy as np

    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not m:
        raise ValueError("only binary PGM and PPM")
    w, h, top, n = int(m[2]), int(m[3]), int(m[4]), 3 if m[1] == b"P6" else 1
    return h, w, np.frombuffer(raw, np.uint8 if top < 256 else ">u2", h * w * n, m.end()).reshape(h, w, n)


def read_netpbm(spark: SparkSession, path: str) -> DataFrame:
    """PIXELS of binary PGM and PPM files; a file is a scene."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                h, w, a = _decoded(bytes(raw))
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"scene": name.rsplit("/", 1)[-1], "y": y.astype("int32"), "x": x.astype("int32"), "bands": list(a.reshape(h * w, -1).astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIXELS)


def encode_pgm(height: int, width: int, values: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, height) + values


def read_raw(spark: SparkSession, path: str, height: int, width: int, bands: int, kind: str, interleave: str = "bsq", header: int = 0) -> DataFrame:
    """PIXELS of raw rasters: bsq, bil or bip."""

    def run(batches):
        import numpy as np
        import pandas as pd

        shape = {"bsq": (bands, height, width), "bil": (height, bands, width), "bip": (height, width, bands)}[interleave]
        axes = {"bsq": (1, 2, 0), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                a = np.frombuffer(bytes(raw), "<" + TYPES[kind], height * width * bands, header).reshape(shape).transpose(axes)
                y, x = np.divmod(np.arange(height * width), width)
                yield pd.DataFrame({"scene": name.rsplit("/", 1)[-1], "y": y.astype("int32"), "x": x.astype("int32"), "bands": list(a.reshape(height * width, bands).astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIXELS)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, intensity, angle, return_no, n_returns, class of LAS files of point formats 0 to 3."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for raw in b["content"]:
                raw = bytes(raw)
                if raw[:4] != b"LASF":
                    raise ValueError("not a LAS file")
                at, size = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<H", raw, 105)[0]
                n = struct.unpack_from("<I", raw, 107)[0]
                scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
                kind = np.dtype({"names": ["p", "i", "r", "c", "a"], "formats": ["3<i4", "<u2", "u1", "u1", "i1"], "offsets": [0, 12, 14, 15, 16], "itemsize": size})
                t = np.frombuffer(raw, kind, n, at)
                xyz = t["p"] * np.array(scale) + np.array(shift)
                yield pd.DataFrame({"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": t["i"].astype("int32"), "angle": t["a"].astype("int32"), "return_no": (t["r"] & 7).astype("int32"), "n_returns": (t["r"] >> 3 & 7).astype("int32"), "class": (t["c"] & 31).astype("int32")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "x double, y double, z double, intensity int, angle int, return_no int, n_returns int, class int")


# --- metadata -----------------------------------------------------------------------------------------------------


def info(px: DataFrame, bands: list[str], dx: float = 1.0, dy: float = 1.0, ulx: float = 0.0, uly: float = 0.0) -> DataFrame:
    """A report for each scene: rows, columns, box, centre, range and mean of each band."""
    r = px.groupBy("scene").agg((F.max("y") + 1).alias("nl"), (F.max("x") + 1).alias("ns"), F.lit(len(bands)).alias("nb"), *[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    lrx, lry = F.lit(ulx) + F.col("ns") * dx, F.lit(uly) - F.col("nl") * dy
    return r.withColumns({"ulx": F.lit(ulx), "uly": F.lit(uly), "lrx": lrx, "lry": lry, "cx": (F.lit(ulx) + lrx) / 2, "cy": (F.lit(uly) + lry) / 2})


def color_table(spark: SparkSession, n: int = 256, ramp: bool = False) -> DataFrame:
    """id, r, g, b, a: a grey table, or a ramp from blue over green to red."""
    i, top = F.col("id").cast("int"), n - 1
    v = F.floor(i * 255 / top).cast("int")
    if not ramp:
        return spark.range(n).select(i.alias("id"), v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))
    return spark.range(n).select(i.alias("id"), F.greatest(F.lit(0), 2 * v - 255).alias("r"), (255 - F.abs(2 * v - 255)).alias("g"), F.greatest(F.lit(0), 255 - 2 * v).alias("b"), F.lit(255).alias("a"))


def colored(g: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels with the colour of their value."""
    return g.join(table.withColumnRenamed("id", "__id"), F.col("v").cast("int") == F.col("__id")).drop("__id")
