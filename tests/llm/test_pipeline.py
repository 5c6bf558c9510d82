"""Each stage against a brute-force version, on its own input."""

import os

import pytest
from llm_helpers import jaccard_components, prose
from test_decontam import brute

from vigil.llm import decontam, minhash, mix, quality, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "decontamination", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        if name == "tokens":
            break
        assert docs.columns == columns
        after = docs.collect()
        text = {r["doc_id"]: r["text"] for r in before}
        assert all(text[r["doc_id"]] == r["text"] for r in after)
        ids = {r["doc_id"] for r in after}
        if name == "quality":
            wrong = [d for d, x in labels.items() if (d in ids) != (x["quality"] == 1 and x["toxic"] == 0)]
            assert len(wrong) <= 0.02 * len(labels)
        if name == "minhash":
            assert ids == set(jaccard_components(list(text.items()), 5, 80).values()) and len(after) == len(ids)
        if name == "decontamination":
            assert ids == set(text) - {d for d, _ in brute(list(text.items()), items)}
        if name == "mixing":
            assert ids <= set(text) and max(sum(r["doc_id"] == d for r in after) for d in ids) <= 3
        before = after
    assert docs.count() == docs.select("slot").distinct().count() > 0
    assert {d for r in docs.collect() for d in r["doc_ids"]} == ids
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


CLASH = ("each", "own", "own_", "nth", "row", "to", "h", "n", "__gone", "__n", "Text_", "component")


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and long texts, repeated rows, empty tables and clashing names: whole rows come back, and only those decided upon go."""
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 0), (None, None, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(12, 2)), (None, None), (2, "")], "item_id long, text string")
    wide = odd.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(CLASH)])
    whole = sorted(map(str, wide.collect()))
    gone = {"quality": 0, "minhash": 3, "decontamination": 2, "mixing": None}
    for name, f in (("quality", lambda d: quality.accepted(d, labels)), ("minhash", minhash.deduplicated), ("decontamination", lambda d: decontam.decontaminated(d, items)), ("mixing", mix.mixed)):
        left = f(wide)
        rows = left.collect()
        assert left.columns == wide.columns and set(map(str, rows)) <= set(whole), name
        assert gone[name] is None or len(rows) == len(whole) - gone[name], name
        assert f(wide.limit(0)).count() == 0, name
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()
    assert decontam.decontaminated(odd, items.limit(0)).count() == odd.count()
    assert {d for r in tokens.stored(wide, length=64).select("doc_ids").collect() for d in r["doc_ids"]} == {r["doc_id"] for r in odd.collect()}
    assert tokens.stored(none).count() == 0


def test_rows_with_shared_or_no_ids_are_decided_each(spark):
    bad, good, other = prose(40, 1), prose(40, 2), prose(60, 3)
    docs = spark.createDataFrame([(None, bad), (None, good), (1, bad), (1, good), (2, good), (3, other), (3, prose(60, 4)), (3, other)], "doc_id long, text string")
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] == good) for r in decontam.decontaminated(docs, items).collect() if r["doc_id"] != 3) == [(0, True), (1, True), (2, True)]
    kept = minhash.deduplicated(docs.where("doc_id = 3"))
    assert sorted(r["text"] for r in kept.collect()) == sorted([other, prose(60, 4)])
