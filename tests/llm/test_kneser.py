import math
import zlib
from collections import Counter

import pytest
from llm_helpers import ODD, prose

from vigil.llm import kneser


def brute(docs):
    """The model by dictionaries."""
    words = [(d, (t or "").encode().lower().split() + [0]) for d, t in docs]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c, pairs = Counter(), Counter()
    for d, w in words:
        if not out(d):
            c.update(w)
            pairs.update(zip([1, *w[:-1]], w, strict=True))
    n, v, types = sum(c.values()), len(c), len(pairs)
    left = Counter(b for _, b in pairs)
    few = lambda x: [sum(k == j for k in x.values()) for j in (1, 2, 3, 4)]
    d2, d1 = kneser._discounts(few(pairs)), kneser._discounts(few(left))
    total, kinds = Counter(), Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        kinds[a, min(k, 3)] += 1
    free = sum(d1[min(k, 3) - 1] for k in left.values()) / types if types else 1.0

    def p(a, b):
        low = (left[b] - d1[min(left[b], 3) - 1]) / types if left[b] else 0.0
        low += free / (v + 1)
        if not total[a]:
            return low
        k = pairs[a, b]
        return max(0, k - (d2[min(k, 3) - 1] if k else 0)) / total[a] + sum(d2[j] * kinds[a, j + 1] for j in range(3)) / total[a] * low

    rows = []
    for d, w in words:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        rows.append((d, out(d), len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([1, *w[:-1]], w, strict=True))))
    return rows, p, list(c)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9)


@pytest.mark.parametrize("shards", [None, 5])
def test_against_dictionaries(spark, shards, monkeypatch):
    docs = [(i, prose(60, i % 40) + (" the the" * (i % 5))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want, p, vocabulary = brute(docs)
    same(kneser.score(df, kneser.train(df, shards)).collect(), want)
    for a in (vocabulary[3], b"never", 1):
        assert sum(p(a, b) for b in vocabulary) + p(a, b"unseen") == pytest.approx(1)


def test_odd_rows(odd, none, spark):
    same(kneser.perplexities(odd).collect(), brute([(d, t) for d, t, _, _ in ODD])[0])
    assert kneser.perplexities(none).count() == 0
    unseen = next(i for i in range(100) if kneser.held_out(i))
    one = kneser.perplexities(spark.createDataFrame([(unseen, "a b")], "doc_id long, text string")).collect()
    assert one[0]["train_tokens"] == 0 and one[0]["n_known"] == 0 and one[0]["score"] == 0


def test_long_documents_are_scored_in_pieces(spark, monkeypatch):
    docs = [(i, prose(700, i)) for i in (0, 1, 3)]
    want = brute(docs)[0]
    monkeypatch.setattr(kneser, "CHUNK", 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    same(kneser.perplexities(df).collect(), want)
