import glob
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD, prose

from vigil.llm import queries, tokens
from vigil.llm.common import local_path, shared_dir

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutation(n, key):
    assert sorted(tokens.feistel(np.arange(n), n, key).tolist()) == list(range(n))


def test_keys_differ():
    a, b = (tokens.feistel(np.arange(1000), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.2


def test_shards_hold_every_document(spark, tmp_path):
    docs = [(i, prose(5 + i * 3, i)) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    made = tokens.sequences(df, length=64, per_shard=10)
    rows = made.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows))) and all(r["shard"] == r["slot"] // 10 and r["place"] == r["slot"] % 10 for r in rows)
    with open(tokens.TOKENIZER, "rb") as f:
        enc = tokens.encoder(f.read())
    assert sum(r["n_tokens"] for r in rows) == sum(len(enc.encode_ordinary(t)) + 1 for _, t in docs)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["record"], "<u2")
        assert len(ids) == 64 and (ids[r["n_tokens"] :] == 50256).all()
        pieces[r["slot"]] = ids[: r["n_tokens"]]
    whole = [t for t in (enc.decode(x.tolist()) for k in pieces for x in np.split(pieces[k], np.flatnonzero(pieces[k] == 50256) + 1) for x in [x[x != 50256]] if len(x))]
    text = dict(docs)
    assert sum(map(len, whole)) == sum(map(len, text.values()))
    folder = f"file://{tmp_path}/shards"
    manifest = tokens.write_shards(made, folder).orderBy("shard").collect()
    assert [m["first_slot"] for m in manifest] == [10 * i for i in range(len(manifest))] and sum(m["records"] for m in manifest) == len(rows)
    for first in (0, 7, len(rows) - 3):
        for slot, ids in zip(range(first, first + 3), tokens.read_slots(folder, first, 3, 64, 10), strict=True):
            assert ids.tobytes() == rows[slot]["record"]
    assert not [p for p in os.listdir(tmp_path / "shards") if not p.endswith((".bin", ".parquet"))]


def test_odd_rows(odd, none):
    got = tokens.sequences(odd, length=128).collect()
    assert tokens.sequences(none).count() == 0
    assert sum((np.frombuffer(r["record"], "<u2")[: r["n_tokens"]] == 50256).sum() for r in got) == len(ODD)
    assert {d for r in got for d in r["doc_ids"]} == {d for d, *_ in ODD}


def test_query_writes_the_shards(spark, tmp_path, none):
    docs = spark.createDataFrame([(i, prose(5 + i * 20, i)) for i in range(60)], "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    folders = lambda: set(glob.glob(f"{local_path(shared_dir(spark))}/llm/token-shards-*"))
    before = folders()
    made = queries.op7_tokens(spark, str(tmp_path))
    rows = made.collect()
    (folder,) = folders() - before
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert [r["record"] for r in rows] == [x.tobytes() for x in tokens.read_slots(f"file://{folder}", 0, len(rows))]
    assert rows == tokens.sequences(spark.read.parquet(f"{tmp_path}/documents.parquet")).orderBy("slot").collect()
    with open(f"{folder}/shard-00000000.bin", "r+b") as f:
        f.write(b"spoilt")
    with pytest.raises(Exception, match="is not as written"):
        made.collect()
    assert tokens.stored(none).count() == 0
