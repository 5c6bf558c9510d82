"""The work of fingerprints: evenly dealt, and none for columns that are not asked for."""

from llm_helpers import prose
from pyspark.sql import functions as F

from vigil.llm import fingerprint as fp


def test_buckets_are_partitions(spark):
    """By a hash of their numbers 15 buckets are in about 10 of 15 partitions, so that one task does the work of several."""
    df = spark.createDataFrame([(i, prose(5, i)) for i in range(300)], "doc_id long, text string")
    rows = fp.fingerprints(df, per_bucket=20).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 15 and max(r["count"] for r in rows) <= 40


def test_without_marks(spark, monkeypatch):
    rows = [(i * 3, prose(5 + i % 40, i // 2)) for i in range(60)] + [(None, None), (7, ""), (8, "ab"), (10, "ab" * 20), (11, "ab" * 20 + "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = fp.fingerprints(df, per_bucket=20)
    some = fp.fingerprints(df, per_bucket=20, marks=False)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, some.collect())) == sorted(map(key, whole.select(*some.columns).collect()))
    monkeypatch.setattr(fp, "fingerprint", None)
    assert fp.extension("ab" * 20, 0, "ab" * 20 + "c", 0) == 40 and fp.extension("abc", 1, "xbcd", 1) == 2 and fp.extension("", 0, "a", 0) == 0
