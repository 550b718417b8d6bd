from gridweave.operators import kalman
from gridweave.streaming import kalman as stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(p, t, float((p * 7 + t * 3) % 11), float(t % 3 + 1)) for p in range(3) for t in range(6)]
    for i in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 3 == i], "pixel long, t int, z double, m double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("pixel long, t int, z double, m double").parquet(str(tmp_path / "in"))
    q = stream.filtered(src).writeStream.format("memory").queryName("kal").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["pixel"], r["t"]): r["x"] for r in spark.table("kal").collect()}
    want = {(r["pixel"], r["t"]): r["x"] for r in kalman.kalman(spark.createDataFrame(rows, "pixel long, t int, z double, m double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
