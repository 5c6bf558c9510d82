"""Registered queries over tables of events with values that the test data lacks."""

import math

import duckdb

from vigil import catalogue


def test_zero_divided_by_zero(spark, tmp_path):
    values = [0.0, -0.0, 1.5, -1.5, float("inf"), float("nan"), None]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 00:00:0{i}', 1, 'click', {'NULL' if v is None else repr(str(v)) + '::DOUBLE'}, '')" for i, v in enumerate(values))
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) x(event_id, ts, user_id, event_type, value, props)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    expected = duck.execute(catalogue.ORACLE_SQL["num_div_zero"]).fetchall()
    got = catalogue.QUERIES["num_div_zero"](spark, str(tmp_path)).select("trace", "t", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str) and len(expected) == len(values)
    assert not [r for r in got if r["v"] and not math.isnan(values[r["t"] // 10**9 % 60]) and values[r["t"] // 10**9 % 60] <= 0]


def test_partitions_follow_rows(spark, monkeypatch):
    """What follows signals between samples is in as many partitions as the rows of the frame ask for, which Spark does not merge."""
    from vigil import Eventually, TraceFrame, Until, VarBool, VarFloat, dtype, robustness
    from vigil.sources import frames

    df = spark.range(4000).selectExpr("id % 500 AS k", "id div 500 * 1000000000 AS t", "CAST(id % 7 AS DOUBLE) AS x", "id % 3 = 0 AS b")
    frame = lambda: TraceFrame(df, "k", "t", {"x": ("x", dtype.float64), "b": ("b", dtype.bool_)})
    x = VarFloat("x") > 3.0
    for spec in (Eventually(x, interval=(0, 2)), Until(x, VarBool("b"))):
        few = robustness(spec, frame(), "linear")
        with monkeypatch.context() as m:
            m.setattr(frames, "ROWS", 100)
            many = robustness(spec, frame(), "linear")
            assert many.rdd.getNumPartitions() == 40
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
