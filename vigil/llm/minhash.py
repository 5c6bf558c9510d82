"""Near-duplicates by circulant MinHash, banding and exact Jaccard.

Two permutations of the 32-bit universe make the whole signature: the first scatters the
shingles, the second, shifted circularly by k, gives coordinate k.  Documents with equal shingle
sets are one class.  In each band bucket the class with most bucket neighbours is compared with
every other; what is then in another component is compared with the rest.  So a group of copies
costs as many comparisons as it has members.  A pair is a candidate if it shares a band and, unless that is
switched off, if its sketches differ by no more than chance allows at the similarity asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, save, slim
from .graph import components

#: 38 bands of 5: two sets of Jaccard 0.8 share no band in 3 of 10 million cases.
BANDS, ROWS = 38, 5
K = BANDS * ROWS
#: Coordinates whose two lowest bits may differ: 0.8 differs in 28.5 of 190 on average, 53 is five deviations (4.9 each) more.
MOST_APART = 53
TRAITS = ("s0", "s1", "s2", "u0", "u1", "u2")
CHUNK = 1 << 15
#: Ids of documents that may be broadcast (8 bytes each) to choose texts where they are read; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Sets that share a rare shingle at most.
RARE = 8

U64 = np.uint64


class _Words(dict):
    """Word -> 64-bit hash, forgotten when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def shingles(text: str | bytes | None, n: int, words: _Words) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; fewer words are one shingle, none are none."""
    found = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    m = max(1, len(h) - n + 1)
    out = np.full(m, len(h) if len(h) < n else n, np.uint64)
    for i in range(min(n, len(h))):
        out = _mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + m])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x K circulant MinHash values of nonempty sets."""
    flat = np.concatenate(sets)
    # The first permutation: scatter over the universe of 32 bits.
    place = (_mix(flat * U64(0xFF51AFD7ED558CCD)) >> U64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), K), np.uint32)
    a, b = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
    scaled = place * a
    t, s = np.empty_like(scaled), np.empty_like(scaled)
    for k in range(K):
        # The second permutation, of the place shifted by k: multiply, shift, multiply.
        np.subtract(scaled, np.uint32(k * int(a) & 0xFFFFFFFF), out=t)
        np.right_shift(t, np.uint32(15), out=s)
        np.bitwise_xor(t, s, out=t)
        np.multiply(t, b, out=t)
        np.right_shift(t, np.uint32(16), out=s)
        np.bitwise_xor(t, s, out=t)
        out[:, k] = np.minimum.reduceat(t, starts)
    return out


def _digest(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three longs of the lowest bits, three of the bits above them, and a key for each band."""
    bits = np.zeros((len(sig), 384), np.uint8)
    bits[:, :K] = sig & 1
    bits[:, 192 : 192 + K] = sig >> 1 & 1
    low = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    key = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F)
    for r in range(ROWS):
        key = _mix(key * U64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64))
    return low, key.view(np.int64)


SKETCH = "doc_id long, n long, f1 long, f2 long, " + ", ".join(f"{t} long" for t in TRAITS) + ", bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = _Words()

    def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        low, keys = np.zeros((len(sets), 6), np.int64), np.zeros((len(sets), BANDS), np.int64)
        if full:
            low[full], keys[full] = _digest(signatures([sets[i] for i in full]))
        prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([BANDS * bool(len(s)) for s in sets])]), pa.int32()), pa.array(keys[full].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, (prints[:, 0].copy(), prints[:, 1].copy(), *low.T.copy())), lists], ["doc_id", "n", "f1", "f2", *TRAITS, "bands"])

    for batch in batches:
        ids, sets, held = [], [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(d)
            sets.append(shingles(t.as_py(), n, words))
            held += len(sets[-1])
            if held > CHUNK:
                yield made(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield made(ids, sets)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: the whole corpus is shuffled once, so its bytes count."""
    for batch in batches:
        raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array([pa.compress(r, codec="zstd", asbytes=True) for r in raw], pa.binary())], ["doc_id", "size", "body"])


def _set(size: int, body: bytes, n: int, words: _Words) -> np.ndarray:
    return shingles(pa.decompress(body, size, codec="zstd", asbytes=True) if size else b"", n, words)


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    words, last = _Words(), (None, None)
    for batch in batches:
        a, b = [], []
        for x, y, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last[0] != x:
                last = (x, _set(*packed[:2], n, words))
            other = _set(*packed[2:], n, words)
            both = len(np.intersect1d(last[1], other, assume_unique=True))
            if both and 100 * both >= percent * (len(last[1]) + len(other) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exploded(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        for d, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = _set(*packed, n, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d, np.int64)), pa.array(h)], ["id", "h"])


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80, most_apart: int | None = MOST_APART) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept for every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles (A-Z
    lower-cased; words are runs of anything but ASCII white space; fewer than n words are one shingle).
    Null, empty and blank texts have no shingle and link with nothing.  class_id is the least doc_id with the same
    set, component_id the least that links reach; kept marks the rows whose doc_id is the component's.  Rows that
    repeat a doc_id are one document as far as links go, and each is returned.  Null ids are labelled null and not kept.
    Texts of any length are taken whole.  An empty table gives no rows.  Other columns are not looked at, whatever they are called.

    ``most_apart``: bits of the sketch that a pair may differ in before its texts are fetched; None fetches the texts of every pair of a bucket that
    sizes do not rule out.  What a pair can miss is a common band, and five deviations of the sketch; both are computed in the README.
    """
    docs = slim(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = save(docs.mapInArrow(lambda it: _sketched(it, n), SKETCH), "sketches")
    full = sketches.where("n > 0 and doc_id is not null")
    # One row per class, reduced in each task first: one class may hold a third of all rows.
    best = F.min_by(F.struct(*TRAITS, "bands"), "doc_id").alias("best")
    reps = save(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id"), best).select("class_id", "n", "f1", "f2", "best.*"), "representatives", few=True)
    entries = reps.select(F.col("class_id").alias("id"), F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    mine = entries.join(shared, "band").groupBy("id").agg(F.collect_set(F.struct("band", "c")).alias("bands"), F.sum("c").alias("degree"))  # BANDS of them at most
    traits = reps.groupBy(F.col("class_id").alias("id")).agg(F.min(F.struct("n", *TRAITS)).alias("t")).select("id", "t.*")
    members = save(mine.join(traits, "id"), "members", few=True)  # the classes that share a bucket
    chosen = members.select(F.col("id").alias("doc_id"))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen
    texts = save(docs.join(chosen, "doc_id", "left_semi").mapInArrow(_compressed, "doc_id long, size long, body binary").dropDuplicates(["doc_id"]), "texts")

    def like(p: str, q: str):
        differ = lambda t: F.col(f"{p}.{t}").bitwiseXOR(F.col(f"{q}.{t}"))
        apart = sum((F.bit_count(differ(f"s{i}").bitwiseOR(differ(f"u{i}"))) for i in range(3)), F.lit(0))
        small, large = F.least(f"{p}.n", f"{q}.n"), F.greatest(f"{p}.n", f"{q}.n")
        return (100 * small >= percent * large) & (F.lit(True) if most_apart is None else apart <= most_apart)

    def verified(pairs: DataFrame) -> DataFrame:
        at = lambda k: texts.select(F.col("doc_id").alias(k), F.col("size").alias(f"size_{k}"), F.col("body").alias(f"body_{k}"))
        both = pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "size_a", "body_a", "size_b", "body_b")
        return save(both.mapInArrow(lambda it: _verified(it, n, percent), "a long, b long"), "verified", few=True)

    spread = members.select("id", "degree", "n", *TRAITS, F.explode("bands").alias("e")).select("id", "degree", "n", *TRAITS, "e.band", "e.c")
    centre = F.max(F.struct("degree", "id", "n", *TRAITS)).alias("q")
    stars = spread.alias("p").join(spread.groupBy("band").agg(centre).alias("r"), "band").where(F.col("p.id") != F.col("r.q.id")).where(like("p", "r.q"))
    links = verified(stars.select(F.col("r.q.id").alias("a"), F.col("p.id").alias("b")).distinct())
    found = components(links)
    # What shares a bucket, is no centre of it and is in different components still has to be compared.
    known = members.join(found, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    about = ("id", "degree", "component", "n", *TRAITS, F.transform("bands", lambda e: e["band"]).alias("bands"))
    known = known.select(*about, F.explode(F.filter("bands", lambda e: e["c"] > 2)).alias("e")).withColumn("band", F.col("e.band")).drop("e")
    mixed = known.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("degree", "id")).getField("id").alias("a")).where("x < y")
    rest = save(known.join(mixed, "band").where("id <> a").drop("x", "y", "a", "degree"), "rest", few=True)
    merged = None if rest.isEmpty() else _residual(rest, texts, verified, like, n, percent)
    classes = reps.select("n", "f1", "f2", "class_id").join(found, F.col("class_id") == F.col("node"), "left")
    classes = classes.select("n", "f1", "f2", "class_id", F.coalesce("component", "class_id").alias("component"))
    if merged is not None:
        classes = classes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left").withColumn("component", F.coalesce("least", "component"))
    # Written, so that Spark can split the join: the rows of a class meet only where its number is put on them.
    labelled = save(classes.select("n", "f1", "f2", "class_id", "component"), "labelled", few=True)
    out = sketches.select("doc_id", "n", "f1", "f2").join(labelled, ["n", "f1", "f2"], "left")
    of = lambda *c: F.when(F.col("doc_id").isNotNull(), F.coalesce(*c, "doc_id"))
    out = out.withColumns({"component_id": of("component", "class_id"), "class_id": of("class_id")})
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _residual(rest: DataFrame, texts: DataFrame, verified, like, n: int, percent: int) -> DataFrame | None:
    """(node, component) of the components that links among rest join, or None.

    Shingles that few of these sets have make them apart.  Two sets have no more in common than the fewer of their other shingles and what they share of
    those: either they come from a join of their bucket with that bound, or from a join on those shingles, in which each pairs RARE sets at most.  So no link is
    lost and the pairs of a group are not written out.
    """
    ids = rest.select(F.col("id").alias("doc_id")).distinct()
    held = texts.join(ids, "doc_id", "left_semi").select("doc_id", "size", "body").mapInArrow(lambda it: _exploded(it, n), "id long, h long")
    held = save(held, "rest-shingles", few=True)
    rare = save(held.join(held.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") <= RARE).select("h"), "h"), "rare", few=True)
    own = rare.groupBy(F.col("id").alias("own_id")).agg(F.count("*").alias("own"))
    sets = rest.join(own, F.col("id") == F.col("own_id"), "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own", "own_id")
    enough = lambda common: 100 * common >= percent * (F.col("p.n") + F.col("q.n") - common)
    least = F.least("p.shared", "q.shared")
    apart = (F.col("p.id") < F.col("q.id")) & (F.col("p.component") != F.col("q.component")) & like("p", "q")
    # Of the bands that two sets share, the least one answers for the pair; one is no centre of it, or they have been compared.
    answers = F.col("p.band") == F.array_min(F.array_intersect("p.bands", "q.bands"))
    ends = F.col("p.id").alias("a"), F.col("q.id").alias("b")
    plain = sets.alias("p").join(sets.alias("q"), (F.col("p.band") == F.col("q.band")) & apart & enough(least) & answers).select(*ends)
    some = rare.join(sets.drop("band", "bands").dropDuplicates(["id"]), "id")
    met = some.alias("p").join(some.alias("q"), (F.col("p.h") == F.col("q.h")) & apart)
    met = met.groupBy(*ends).agg(F.count("*").alias("o"), F.first(least).alias("shared"), F.first(F.col("p.n") + F.col("q.n")).alias("sum"))
    met = met.where(100 * (F.col("shared") + F.col("o")) >= percent * (F.col("sum") - F.col("shared") - F.col("o"))).select("a", "b")
    more = verified(plain.union(met).distinct())
    if more.isEmpty():
        return None
    # Only components are joined from here on.
    of = rest.select("id", "component").distinct()
    edges = more.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return components(edges)


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stays per group of near-duplicates (the least doc_id; of rows that repeat it with the same text, one).
    Rows without words or id stay; rows that repeat a doc_id with another text stay or go together."""
    gone = near_duplicates(docs.select("doc_id", "text"), n, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return once(docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti"))
