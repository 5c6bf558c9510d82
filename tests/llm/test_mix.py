import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm.mix import fit, mix, mixed


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 200))
def test_fit_is_the_best_subset_sum(counts, budget):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    sums = {0}
    for s, c in counts.items():
        sums = {x + k * s for x in sums for k in range(c + 1)}
    taken = fit(sizes, n, budget)
    assert (taken >= 0).all() and (taken <= n).all()
    assert int((taken * sizes).sum()) == max(x for x in sums if x <= budget)


def test_fit_of_large_budgets():
    sizes, n = np.arange(1, 2000), np.full(1999, 500)
    for budget in (10, 70_000, 123_456_789, 900_000_000):
        assert int((fit(sizes, n, budget) * sizes).sum()) == budget
    assert fit(np.array([10**9]), np.array([3]), 2 * 10**9 + 5).tolist() == [2]
    assert fit(np.array([10**9, 3]), np.array([3, 1]), 10**9 - 5).tolist() == [0, 1]
    sizes, n = np.array([70_001, 90_002, 300_000]), np.array([3, 3, 2])
    sums = {a * 70_001 + b * 90_002 + c * 300_000 for a in range(4) for b in range(4) for c in range(3)}
    for budget in (400_000, 777_777, 950_123):
        assert int((fit(sizes, n, budget, None) * sizes).sum()) == max(x for x in sums if x <= budget)


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    """The excess goes round by round to the sources that are below their caps."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / share for s in order}
        more = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def test_whole_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 7 if i % 3 else 0}") for i in range(400)]
    rows += [(1000 + i, "z " * 5, None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(5)).collect()))
    source, size = {d: s for d, _, s in rows}, {d: len(t.split()) for d, t, _ in rows}
    sizes = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    want = expected_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 if s is not None else abs(taken[s] - want[s]) <= 5


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in mix(odd).collect()}
    assert mix(odd).count() == odd.count() and mix(none).count() == 0
    assert got[1]["taken"] == got[2]["taken"] == got[3]["taken"] == 0 and got[8]["size"] == 30_000
    clash = odd.selectExpr("*", "1 AS each", "8 AS __n", "'k' AS nth", "2 AS own", "3 AS row", "4 AS `to`", "5 AS copies", "6 AS h", "7 AS __gone")
    back = mixed(clash)
    assert back.columns == clash.columns and {tuple(r[8:]) for r in back.collect()} == {(1, 8, "k", 2, 3, 4, 5, 6, 7)}
    again = mixed(odd)
    assert again.columns == odd.columns
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect() if r["doc_id"] not in (6,))
    assert words(again) == sum(r["taken"] for r in mix(odd).collect() if r["doc_id"] != 6)
    assert mixed(none).count() == 0
