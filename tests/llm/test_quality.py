import math
import os
import random
import tracemalloc

from llm_helpers import ODD, prose
from pyspark.sql import functions as F

from vigil.llm.common import local_path, save
from vigil.llm.quality import accepted, classify


def corpus():
    """Clean prose, menus, repeated words and insults, over hosts of which one is mostly menus."""
    r = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        kind = r.choice(["good"] * 6 + ["menu", "repeat", "toxic"])
        host = "bad" if kind == "menu" and r.random() < 0.8 else r.choice("abcd")
        text = prose(r.randint(20, 120), i)
        if kind == "menu":
            text = " | ".join(text.split())
        if kind == "repeat":
            text = " ".join(text.split()[:1] * 60)
        if kind == "toxic":
            w = text.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "trash"]))
            text = " ".join(w)
        docs.append((i, host, r.choice("xy"), text, kind))
        if i % 3:
            labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic")))
    return docs, labels


DOCS = "doc_id long, host string, path string, text string, kind string"
LABELS = "doc_id long, quality int, toxic int"


def shrunk(rows):
    """(host, path, p) -> the posterior of each row's path without the row itself, and the whole mean, by plain sums."""
    def strength(groups):
        n = sum(len(g) for g in groups)
        mu = sum(map(sum, groups)) / n
        mm = sum(sum(g) ** 2 / len(g) for g in groups)
        within = max(0, sum(p * p for g in groups for p in g) - mm) / max(1, n - len(groups))
        between = max(0, mm / n - mu * mu - within * (len(groups) - 1) / n)
        return mu, min(1e4, max(1, within / between if between else 1e4))

    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    (mu, kh), (_, kp) = strength(list(hosts.values())), strength(list(paths.values()))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + kh * mu) / (len(hosts[h]) - 1 + kh)
        out.append((sum(paths[h, q]) - p + kp * host) / (len(paths[h, q]) - 1 + kp))
    return mu, out


def test_posteriors_against_plain_sums(spark):
    docs, labels = corpus()
    docs += [(5000, "tiny", "x", docs[0][3], "good"), (5001, None, None, docs[1][3], "good")]
    site = {d[0]: (d[1] or "", d[2] or "") for d in docs}
    got = classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    for head in ("low", "toxic"):
        mu, want = shrunk([(*site[r["doc_id"]], r[f"doc_{head}"]) for r in got])
        for r, s in zip(got, want, strict=True):
            assert abs(r[f"site_{head}"] - s) < 1e-4
            logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
            z = logit(r[f"doc_{head}"]) + max(-2, min(2, logit(s) - math.log(mu / (1 - mu))))
            assert abs(r[f"p_{head}"] - 1 / (1 + math.exp(-z))) < 1e-2


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in classify(df, known).collect()}
    fresh = [d for d in docs if d[0] % 3 == 0]
    right = sum(got[d[0]]["kept"] == (d[4] == "good") for d in fresh)
    assert len(got) == len(docs) and right >= 0.97 * len(fresh)
    site = lambda h: sum(got[d[0]]["site_low"] for d in docs if d[1] == h) / sum(d[1] == h for d in docs)
    assert site("bad") > 3 * site("a")
    assert {r["doc_id"] for r in accepted(df, known, "host", "path").collect()} == {d for d in got if got[d]["kept"]}


def test_small_sites_shrink(spark):
    docs, labels = corpus()
    docs.append((5000, "tiny", "z", prose(50, 77), "good"))
    got = {r["doc_id"]: r for r in classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    mean = sum(r["doc_low"] for r in got.values()) / len(got)
    assert abs(got[5000]["site_low"] - mean) < 0.02  # its only document does not count for itself


def test_odd_rows(odd, none, spark):
    sited = lambda df: df.withColumns({"host": F.col("source"), "path": F.col("lang")})
    few = spark.createDataFrame([(4, 1, 0), (9, 0, None), (None, 1, 1)], LABELS)
    for labels in (few, few.limit(0)):
        got = classify(sited(odd), labels).collect()
        assert len(got) == len(ODD) and all(r["kept"] for r in got)
        assert classify(sited(none), labels).count() == 0
        assert accepted(odd, labels).columns == odd.columns


def test_the_driver_holds_numbers_not_objects(spark):
    """The sample's features, some 320 of each of 600 documents, come to the driver as columns of numbers."""
    r = random.Random(3)
    kinds = [[f"{a}{i:03d}" for i in range(400)] for a in "gb"]
    docs = spark.createDataFrame([(i, "h", "p", " ".join(r.sample(kinds[i % 2], 320))) for i in range(600)], "doc_id long, host string, path string, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(600)], LABELS)
    tracemalloc.start()
    try:
        found = classify(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(x["kept"] == (x["doc_id"] % 2 == 0) for x in found.collect())
    assert most < 14 << 20


def test_saved_tables_have_no_mark_of_success(spark):
    """The driver starts processes to write one, each of which may count its memory anew."""
    at = save(spark.range(3), "unmarked")
    assert sorted(x.id for x in at.collect()) == [0, 1, 2]
    assert not any(x.startswith("_") for x in os.listdir(local_path(os.path.dirname(at.inputFiles()[0]))))
