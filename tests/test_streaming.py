import shutil

import pytest

from vigil import Always, Next, VarBool, VarFloat, dtype, parse_expr
from vigil.streaming.monitor import horizon, monitor, verdicts


def test_horizon():
    assert horizon(parse_expr("G[0,2](a -> F[1,3] b)")) == 5 * 10**9
    for bad in (Always(VarBool("a")), Next(VarBool("a"))):
        with pytest.raises(ValueError):
            horizon(bad)


def test_verdicts():
    x = [1.0, -2, 3, 0, -1, -4, 6]
    times = [t * 10**9 for t in range(7)]
    assert verdicts(parse_expr("F[0,2](x > 0.0)"), times, {"x": x}) == [3, 3, 3, 0, 6, 6, 6]
    assert verdicts(parse_expr("(x > -5.0) U[0,2] (x > 2.0)"), times, {"x": x})[2] == 1


def test_stream_gives_each_verdict_once(spark, tmp_path):
    rows = [(u, f"2024-01-01 00:00:{s:02d}", float((s * 7 + u) % 11)) for u in (1, 2) for s in range(0, 50, 5)] + [(1, "2024-01-01 01:00:00", 0.0), (2, "2024-01-01 01:00:00", 0.0)]
    df = spark.createDataFrame(rows, "u long, at string, v double").selectExpr("u", "cast(at as timestamp) at", "v")
    half = df.where("at < '2024-01-01 00:00:25'"), df.where("at >= '2024-01-01 00:00:25' and at < '2024-01-01 00:30:00'"), df.where("at >= '2024-01-01 00:30:00'")
    folder = str(tmp_path / "in")
    shutil.rmtree(folder, ignore_errors=True)
    for part in half:
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    out = monitor("G[0,10](v < 8.0)", stream, trace="u", time="at", signals={"v": ("v", dtype.float64)}, delay="1 second")
    q = out.writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["trace"], str(r["time"]), r["rob"]) for r in spark.table("verdicts").collect())
    expected = []
    for u in (1, 2):
        s = [(x, float((x * 7 + u) % 11)) for x in range(0, 50, 5)]
        expected += [(u, f"2024-01-01 00:00:{t:02d}", min(8 - v for x, v in s if t <= x <= t + 10)) for t, _ in s]
    assert got == sorted(expected)
    assert VarFloat("v").kind is dtype.float64
