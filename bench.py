"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query writes all its rows to a sink that drops them; a figure is the median of $BENCH_RUNS runs after one to warm up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from vigil import TraceFrame, catalogue, dtype, robustness  # noqa: E402

NESTED = "G[0,86400]((value > 350.0) -> F[0,86400]((value < 150.0) & G[0,7200](value < 400.0)))"


def nested_spec(spark, sf_dir):
    return robustness(NESTED, catalogue.events(spark, sf_dir), "constant", grid="samples")


def long_traces(spark, sf_dir):
    """All events of a kind as one trace, windows of a tenth of it."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    frame = TraceFrame(df, "event_type", "ts", {"value": ("value", dtype.float64)}, aligned=True)
    return robustness("F[0,259200](value > 350.0)", frame, "constant", grid="samples", wide=True)


QUERIES = {n: catalogue.QUERIES[n] for n in ("always", "eventually", "eventually_timed", "until", "until_timed", "parsed_spec", "parsed_spec_exact", "eventually_exact", "until_exact", "interp_linear")} | {"nested_spec": nested_spec, "long_traces": long_traces}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in QUERIES.items():
        taken = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
