import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD
from pyspark.sql import functions as F

from vigil.llm import secrets

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(found))


def scanned(spark, texts, **owner):
    rows = [(i, "o", "r", t) for i, t in enumerate(texts)]
    return secrets.scan(spark.createDataFrame(rows, "doc_id long, owner string, repository string, text string"), **owner)


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abc", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "-", "\n", "é", "\U0001f600", "ghp_", "x" * 30]


def test_spans_against_re(spark):
    texts: list = []

    @settings(max_examples=250, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=14))
    def collect(pieces):
        texts.append("".join(pieces))

    collect()
    texts += ["password = token: abcdefgh", "token==abcdef", "AKIA" + "AKIA" * 5, "f" * 23, "g" + "f" * 24 + "g", "secret:  'a/b+c_d=.-'", "x" * 200_000 + " token=abcdef1"]
    for r in scanned(spark, texts).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(list(filter(None, want.split(","))))


def test_ownership(spark):
    wide, own, weak = "token=wide0123456789abcd", "token=mine9876543210zyxw", "password=aaaaaaaa"
    rows = [(i, f"o{i}", f"r{i}", wide) for i in range(6)] + [(10, "o1", "r1", own), (11, "o1", "r1", own), (12, "o1", "r1", weak)]
    df = spark.createDataFrame(rows, "doc_id long, owner string, repository string, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert all(got[i]["n_copied"] == 1 and got[i]["n_live"] == 0 for i in range(6))
    assert all(got[i]["n_live"] == 1 and got[i]["live_spans"] == "assign:0:24" for i in (10, 11))
    assert got[12]["n_live"] == got[12]["n_copied"] == 0 and got[12]["spans"]


def test_odd_rows(odd, none):
    as_owned = lambda df: df.withColumns({"owner": F.col("source"), "repository": F.col("lang")})
    got = secrets.scan(as_owned(odd)).collect()
    assert len(got) == len(ODD) and secrets.scan(as_owned(none)).count() == 0
    assert {r["base_sha256"] for r in got if r["doc_id"] in (1, 2, 3)} == {hashlib.sha256(b"").hexdigest()}


def test_no_python(spark):
    plan = scanned(spark, ["token=abcdef1"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
