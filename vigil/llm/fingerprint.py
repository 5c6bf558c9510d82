"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text answers the hash of any span, so spans of equal width compare
in constant time and the longest common extension of two positions is a binary search.
Hashes are taken modulo the Mersenne prime 2**31 - 1 with two bases (62 bits together).
A fingerprint holds the length, the hash of the whole text and the smallest hashes of its
spans; the likeness of two fingerprints estimates the share of spans that they have in common.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim

P = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_017)
#: Code points hashed at once, code points of a span, span hashes that a fingerprint keeps, their bits.
BLOCK, WIDTH, KEEP, BITS = 1 << 18, 8, 32, 40
LEAST = -(1 << 63)
#: Code points of a common extension that are compared one by one.
HEAD = 32


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod P for x below 2**63, without division."""
    for _ in range(2):
        high = x >> 31
        x = x & P
        x += high
    x -= (x >= P) * np.uint64(P)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), P)))])
    return out[:n]


_tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _table(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    size = 1 << max(12, (n + 1).bit_length())
    if not any(k >= size for k in _tables):
        _tables[size] = [(_powers(b, size), _powers(pow(b, -1, P), size)) for b in BASES]
    return _tables[min(k for k in _tables if k >= size)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays of one text (or block of it) of code points."""

    def __init__(self, text: str | np.ndarray):
        c = codes(text) if isinstance(text, str) else text
        self.n = len(c)
        self.tables = _table(self.n)
        self.prefix = []
        for power, _ in self.tables:
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod((c + np.uint64(1)) * power[: self.n]), out=h[1:])
            self.prefix.append(_mod(h))

    def spans(self, width: int) -> np.ndarray:
        """The hash of every span of so many code points, in order."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        a, b = (_mod(_mod(h[width:] + np.uint64(P) - h[:m]) * inverse[:m]) for h, (_, inverse) in zip(self.prefix, self.tables, strict=True))
        return (a << np.uint64(31)) | b

    def span(self, start: int, width: int) -> int:
        out = 0
        for h, (_, inverse) in zip(self.prefix, self.tables, strict=True):
            out = out << 31 | (int(h[start + width]) - int(h[start])) % P * int(inverse[start]) % P
        return out

    def equal(self, start: int, other: PrefixHash, at: int, width: int) -> bool:
        """Whether two spans are equal, in constant time."""
        return start + width <= self.n and at + width <= other.n and self.span(start, width) == other.span(at, width)

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """How many code points from start on equal those of other from at on, by binary search."""
        most = max(0, min(self.n - start, other.n - at))
        return bisect.bisect_left(range(1, most + 1), True, key=lambda k: not self.equal(start, other, at, k))


def extension(a: str, start: int, b: str, at: int) -> int:
    """How many code points of a from start on equal those of b from at on.  Blocks that grow to BLOCK are compared by their prefix hashes, so that the work follows the answer; the first HEAD as they are."""
    if a[start : start + HEAD] != b[at : at + HEAD]:
        return next((k for k, (x, y) in enumerate(zip(a[start : start + HEAD], b[at : at + HEAD])) if x != y), max(0, min(HEAD, len(a) - start, len(b) - at)))
    k, width = 0, 256
    while min(len(a) - start, len(b) - at) > k:
        found = PrefixHash(a[start + k : start + k + width]).extension(0, PrefixHash(b[at + k : at + k + width]), 0)
        k += found
        if found < width:
            break
        width = min(4 * width, BLOCK)
    return k


def _least(h: np.ndarray) -> np.ndarray:
    """The KEEP smallest distinct hashes after mixing."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    some = 3 * KEEP
    if len(h) > some and len(out := np.unique(np.partition(h, some)[:some])) >= KEEP:
        return out[:KEEP]
    return np.unique(h)[:KEEP]


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint of a whole text and its span hashes.  Texts beyond BLOCK code points are hashed
    block by block, each with the start of the next, so that memory stays bounded."""
    c = codes(text)
    whole, least, power = [0, 0], np.zeros(0, np.uint64), [1, 1]
    for at in range(0, max(1, len(c)), BLOCK):
        own = PrefixHash(c[at : at + BLOCK + WIDTH - 1])
        k = min(BLOCK, len(c) - at)
        for i, h in enumerate(own.prefix):
            whole[i] = (whole[i] + int(h[k]) * power[i]) % P
            power[i] = power[i] * pow(BASES[i], k, P) % P
        if len(c):
            least = np.union1d(least, _least(own.spans(min(WIDTH, len(c)))))[:KEEP]
    return f"{len(c):x}-{whole[0] << 31 | whole[1]:016x}-" + "".join(f"{x:010x}" for x in least.tolist()), least


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common spans, 0 to 1, of two texts by their fingerprints' hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEEP]
    return float(np.isin(union, np.intersect1d(a, b)).sum() / len(union))


def _dealt(batches: Iterator[pa.RecordBatch], splits: list[int], guests: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows to their buckets; the first row of a bucket also to the bucket that comes before it."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for d, t in zip(ids, texts, strict=True):
            key, raw = LEAST if d is None else d, (t or "").encode("utf-8", "surrogatepass")
            row = (key, d, xxhash.xxh3_64_intdigest(raw) >> 1, len(raw), pa.compress(raw, codec="zstd", asbytes=True))
            rows.append((bisect.bisect_left(splits, key), 0, *row))
            if key in guests:
                rows.append((guests[key], 1, *row))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "guest", "key", "doc_id", "h", "size", "body"])


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("same_edited", pa.int64()), ("same_next", pa.int64())])


#: The columns that no fingerprint is needed for.
PLAIN = [OUT.get_field_index(c) for c in ("doc_id", "n_chars", "edited_sha256", "same_edited", "same_next")]


def _compared(batches: Iterator[pa.RecordBatch], marks: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, own rows before guests, key descending.  Without marks, the PLAIN columns."""
    last: tuple | None = None
    out: list[tuple] = []
    for batch in batches:
        for bucket, guest, doc_id, size, body in zip(*(batch.column(k).to_pylist() for k in ("bucket", "guest", "doc_id", "size", "body")), strict=True):
            if guest and (last is None or last[0] != bucket):
                continue
            text = pa.decompress(body, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else ""
            own = fingerprint(text) if marks else None
            if last is not None and last[0] == bucket:
                _, d, old, before = last
                half = len(old) // 2
                stays = len(old) - half
                edited = old[:stays] + text[:half]
                likes = []
                if marks:
                    (mark, least), changed = before, fingerprint(edited)
                    likes = [mark, changed[0], likeness(least, changed[1]), likeness(least, own[1])]
                out.append((d, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), *likes, stays + extension(old, stays, text, 0), extension(old, 0, text, 0)))
            last = None if guest else (bucket, doc_id, text, own)
        if out:
            schema = OUT if marks else pa.schema([OUT.field(i) for i in PLAIN])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []


def fingerprints(docs: DataFrame, per_bucket: int = 4096, *, marks: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): n_chars, fingerprint, and the likeness to the next document
    (descending doc_id, after the last the first) and to the text whose last half is replaced by the next one's start.
    same_edited and same_next: how many code points from the start the text shares with either, by the longest common extension.

    Null text is empty; equal texts have equal fingerprints; rows that share a doc_id follow each other by a hash of
    their texts; null ids come last.  Texts go through one shuffle, compressed, to buckets of neighbouring ids; the
    first document of a bucket is copied into the bucket before it.  The driver sees the bounds and the first id of each bucket only.
    An empty table gives no rows.  marks=False leaves out fingerprints and likeness, which are most of the work, for all rows.
    """
    spark = slim(docs).sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"))
    n = ids.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_bucket))
    splits = sorted({int(x) for x in ids.approxQuantile("key", [i / wanted for i in range(1, wanted)], 0.2 / wanted)}) if n and wanted > 1 else []
    bucket = F.pandas_udf(lambda s: pd.Series(np.searchsorted(np.array(splits, np.int64), s.to_numpy(np.int64), "left")), "long")
    heads = sorted((r["bucket"], r["key"]) for r in ids.groupBy(bucket("key").alias("bucket")).agg(F.max("key").alias("key")).collect())
    guests = {key: heads[(i + 1) % len(heads)][0] for i, (_, key) in enumerate(heads)}
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _dealt(it, splits, guests), "bucket long, guest long, key long, doc_id long, h long, size long, body binary")
    # Each bucket is a partition: by a hash of their numbers some partitions would hold several buckets, and as many none.
    ordered = dealt.repartitionById(wanted, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.desc("key"), "h")
    kinds = ["doc_id long", "n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double", "same_edited long", "same_next long"]
    return ordered.mapInArrow(lambda it: _compared(it, marks), ", ".join(kinds if marks else [kinds[i] for i in PLAIN]))


def common_extension(pairs: DataFrame, a: str, b: str, start: str, at: str, out: str = "extension") -> DataFrame:
    """pairs with the number of code points that text a from start on and text b from at on have in common (null for null)."""

    @F.pandas_udf("long")
    def lce(x: pd.Series, y: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None or pd.isna(s) or pd.isna(t) else extension(p, int(s), q, int(t)) for p, q, s, t in zip(x, y, i, j, strict=True)], dtype="Int64")

    return pairs.withColumn(out, lce(a, b, start, at))
