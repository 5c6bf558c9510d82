import hashlib

from llm_helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import fingerprint as fp


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.data())
def test_spans(a, b, data):
    x, y = fp.PrefixHash(a), fp.PrefixHash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert x.extension(i, y, j) == k
    for n in range(min(len(a) - i, len(b) - j) + 1):
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    if len(a) >= 3:
        assert [int(h) for h in x.spans(3)] == [x.span(p, 3) for p in range(len(a) - 2)]


def test_blocks_do_not_show(monkeypatch):
    text = prose(3000, 4)
    whole = fp.fingerprint(text)[0]
    monkeypatch.setattr(fp, "BLOCK", 500)
    assert fp.fingerprint(text)[0] == whole


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_extension_over_blocks(monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 700)
    a = prose(2000, 5)
    for cut in (0, 1, 255, 256, 257, 1279, 1280, 1281, 5000, len(a)):
        assert fp.extension(a, 0, a[:cut] + "#" + a[cut:], 0) == cut
        assert fp.extension(a, 3, "xy" + a[3:cut], 2) == max(0, cut - 3)
    assert fp.extension(a, 0, a, 0) == len(a) and fp.extension("", 0, a, 0) == 0 and fp.extension(a, len(a), a, 0) == 0


def brute(docs):
    """docs by descending id (None last, ties by hash of the text are not told apart)."""
    out = []
    for k, (d, t) in enumerate(docs):
        t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        (m, a), (x, b), (_, c) = fp.fingerprint(t), fp.fingerprint(e), fp.fingerprint(n)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), m, x, fp.likeness(a, b), fp.likeness(a, c), shared(t, e), shared(t, n)))
    return out


def test_neighbours(spark):
    docs = [(i * 3, prose(5 + i % 40, i // 2)) for i in range(300)]
    docs[7:9] = [(21, docs[6][1] + " more"), (24, docs[6][1])]
    for rows, parts in ((docs, 7), (docs[:1], 1), (docs[:2], 2)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(map(tuple, fp.fingerprints(df, per_bucket=20).collect()))
        assert got == sorted(brute(sorted(rows, reverse=True)))


def test_likeness_tells_edits_from_others():
    a, half, other = (fp.fingerprint(t)[1] for t in (prose(400, 1), prose(200, 1) + prose(200, 2), prose(400, 3)))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, half) > fp.likeness(a, other) + 0.1


def test_odd_rows(odd, none, spark):
    got = fp.fingerprints(odd).collect()
    assert len(got) == odd.count() and fp.fingerprints(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["n_chars"] == 0 and by[9]["fingerprint"] == by[10]["fingerprint"]
    assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    pairs = spark.createDataFrame([("abcd", "xbcy", 1, 1), (None, "a", 0, 0), ("a", "a", 5, 0)], "p string, q string, i int, j int")
    assert [r["extension"] for r in fp.common_extension(pairs, "p", "q", "i", "j").collect()] == [2, None, 0]
