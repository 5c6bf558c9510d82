import random
from collections import Counter

from llm_helpers import prose

from vigil.llm.decontam import contaminated, decontaminated


def brute(docs, items, width=5):
    out = {}
    cut = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    for i, t in items:
        iw = (t or "").lower().split()
        if not iw:
            continue
        k = min(width, len(iw))
        known = Counter(cut(iw, k))
        for d, text in docs:
            w = (text or "").lower().split()
            n = min(len(iw), len(w))
            for s in range(len(w) - n + 1):
                here = Counter(cut(w[s : s + n], k))
                both, every = sum((here & known).values()), sum((here | known).values())
                if every and 100 * both >= 80 * every:
                    out[d, i] = max(out.get((d, i), 0), round(both / every, 6))
    return out


def test_against_all_windows(spark):
    r = random.Random(4)
    items = [(i, prose(r.randint(14, 55), 500 + i)) for i in range(25)] + [(100, "ba ba ba ba ba ba ba ba"), (101, "two words"), (102, ""), (103, None), (104, prose(20, 500) + " " + prose(20, 501))]
    docs = []
    for d in range(150):
        w = prose(r.randint(0, 150), d).split()
        for _ in range(r.randrange(3)):
            x = (r.choice(items)[1] or "").split()
            for _ in range(r.randrange(4)):
                if x:
                    k = r.randrange(len(x))
                    x[k : k + 1] = r.choice([[], ["new"], [x[k], "more"]])
            x = x[r.randrange(3) :]
            at = r.randrange(len(w) + 1)
            w[at:at] = [v.upper() if r.random() < 0.2 else v for v in x]
        docs.append((d, "\t ".join(w)))
    docs += [(1000, "ba " * 40), (1001, items[3][1]), (1002, " ".join(items[4][1].split()[:-2])), (1003, "two words"), (1004, items[5][1].split()[0])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 20 and {(x["doc_id"], x["item_id"]): x["similarity"] for x in got} == want and len(got) == len(want)
    text = dict(docs)
    for x in got:
        assert 0 <= x["start"] and x["start"] + x["n_words"] <= len(text[x["doc_id"]].split())


def test_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, prose(12, 2), "c"), (1, prose(12, 2), "c"), (2, None, "c"), (None, "no id here", "c")], "item_id long, text string, doc_id string")
    got = sorted((x["doc_id"] or 0, x["item_id"] or 0) for x in contaminated(odd, items).collect())
    assert got == [(0, 0), (9, 1), (10, 1)]
    assert contaminated(none, items).count() == contaminated(odd, items.limit(0)).count() == 0
    left = decontaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3


def test_no_python(odd, spark):
    plan = contaminated(odd, spark.createDataFrame([(1, prose(12, 2))], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_rows_of_a_null_or_repeated_id_stay(spark):
    item = prose(20, 1)
    docs = [(None, item), (None, prose(30, 2)), (None, None), (1, item), (1, prose(30, 3)), (2, prose(30, 4))]
    left = decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(left.collect(), key=str) == sorted((x for x in docs if x[1] != item), key=str)
