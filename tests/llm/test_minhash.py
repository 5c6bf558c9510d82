import random

import numpy as np
from llm_helpers import WORDS, jaccard_components, prose, shingle_set

from vigil.llm.graph import components
from vigil.llm.minhash import K, _Words, deduplicated, near_duplicates, shingles, signatures


def test_signatures_estimate_jaccard():
    words = _Words()
    a = [shingles(prose(400, 1), 4, words), shingles(prose(300, 1) + " " + prose(100, 2), 4, words)]
    sig = signatures(a)
    true = len(np.intersect1d(*a)) / len(np.union1d(*a))
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / K) ** 0.5


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_against_all_pairs(spark):
    r = random.Random(5)
    base = [prose(r.choice((5, 40, 90)), i) for i in range(12)]
    docs = [(i, edited(b, r, r.randrange(6))) for i, b in enumerate(base * 10)]
    common = prose(50, 99)
    docs += [(1000 + i, f"{common} {prose(30, 2000 + i)}") for i in range(40)] + [(2000 + i, common) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n, percent in ((4, 80), (5, 80)):
        want = jaccard_components(docs, n, percent)
        got = near_duplicates(df, n, percent).collect()
        assert len(got) == len(docs)
        text = dict(docs)
        for x in got:
            assert x["n_shingles"] == len(shingle_set(text[x["doc_id"]], n))
            assert x["component_id"] == want[x["doc_id"]] and x["kept"] == (want[x["doc_id"]] == x["doc_id"])
    kept = [x["doc_id"] for x in deduplicated(df, 4).collect()]
    assert sorted(kept) == sorted(set(jaccard_components(docs, 4, 80).values()))


def test_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count() and near_duplicates(none).count() == 0
    by = {x["doc_id"]: x for x in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["kept"]
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[10]["component_id"] == 9
    assert by[None]["component_id"] is None and by[None]["kept"] is False
    left = deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9]
    assert deduplicated(none).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 340)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) >= {x for a, b in edges if a != b for x in (a, b)}
