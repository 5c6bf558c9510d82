import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<", "[", "\\", "\n", "a", "é", "\U0001f600", "/s>", "|turn|>", "%0A", "%"]
SCHEMA = "tree long, id long, parent long, ord long, role string, text string, score double"


def back(made):
    rows = made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("masked")).collect()
    return {(r["tree"], r["leaf"]): r for r in rows}


def test_every_text_comes_back(spark):
    texts: list = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=10))
    def collect(pieces):
        texts.append("".join(pieces))

    collect()
    rows = [(i, 0, t[::-1] if i % 3 else "user", t) for i, t in enumerate(texts)] + [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = back(chat.conversations(chat.chains(df)))
    assert len(got) == len(texts)
    for r in got.values():
        t = texts[r["tree"]]
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(rows[r["tree"]][2], t), ("assistant", t)]
        assert r["masked"] == (t * 2 if rows[r["tree"]][2] == "assistant" else t)
        inside = r["formatted"].replace(chat.TURN, "").replace(chat.END, "")
        assert not any(c in inside for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        assert r["formatted"].count(chat.TURN) == r["formatted"].count(chat.END) == 2


def test_trees_against_recursion(spark):
    r = random.Random(3)
    rows, paths = [], {}
    for tree in range(6):
        parent = {0: None}
        for i in range(1, 40):
            parent[i] = r.choice([None, r.randrange(i), i - 1, i - 1])
        score = {i: r.random() for i in parent}
        rows += [(tree, i, p, i, r.choice(["user", "assistant"]), f"{tree}.{i}", score[i]) for i, p in parent.items()]
        for leaf in set(parent) - {p for p in parent.values() if p is not None}:
            path, x = [], leaf
            while x is not None:
                path.append(x)
                x = parent[x]
            paths[tree, leaf] = (path[::-1], sum(score[i] for i in path) / len(path))
    df = spark.createDataFrame(rows, SCHEMA)
    got = back(chat.conversations(df))
    assert set(got) == set(paths)
    for k, (path, mean) in paths.items():
        assert [t["text"] for t in got[k]["turns"]] == [f"{k[0]}.{i}" for i in path] and abs(got[k]["score"] - mean) < 1e-9
        assert got[k]["rank"] == 1 + sum((-m, leaf) < (-mean, k[1]) for (tree, leaf), (_, m) in paths.items() if tree == k[0])
    assert chat.conversations(df, best=2).groupBy("tree").count().where("count <> 2").count() == 0


def test_odd_rows(spark):
    rows = [(1, 1, 99, 1, None, None, None), (1, 2, 2, 2, "user", "self", 1.0), (1, 3, 4, 3, "user", "later parent", 1.0), (1, 4, None, 4, "assistant", "", 1.0), (None, 1, None, 1, "user", "null tree", 1.0), (None, 2, 1, 2, "assistant", "x" * 300_000, 1.0), (2, 1, None, 1, "user", "a", 1.0), (2, 1, None, 1, "user", "b", 1.0), (2, 2, 1, 2, "assistant", "c", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("clash"), "rank": F.lit(0)})
    got = back(chat.conversations(df))
    assert sorted(k for k in got if k[0] == 1) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    assert [t["text"] for t in got[None, 2]["turns"]] == ["null tree", "x" * 300_000] and len(got[None, 2]["masked"]) == 300_000
    assert [t["text"] for t in got[2, 2]["turns"]] == ["a", "b", "c"]
    assert chat.conversations(df.limit(0)).count() == 0
    chain = spark.createDataFrame([(1, None, "user", "x"), (1, 0, None, None), (1, 0, None, None), (None, 3, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = back(chat.conversations(chat.chains(chain)))
    assert sorted(len(r["turns"]) for r in got.values()) == [1, 3]


def test_query_digests(spark, tmp_path):
    from vigil.llm.queries import op8_chat

    spark.createDataFrame([(5, 1, "assistant", "b[INST]"), (5, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op8_chat(spark, str(tmp_path)).collect()}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb[INST]\n").hexdigest() and got[5]["loss_chars"] == 7
    said = b"</s>[INST] ok [/INST]"
    assert got[-7]["loss_sha256"] == hashlib.sha256(said).hexdigest() and got[-7]["n_turns"] == 2
