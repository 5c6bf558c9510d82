"""Interpolated modified Kneser-Ney language model over word pairs.

Pairs are counted in Spark: tasks count chunks of text, counts of one shard of contexts meet in one task, which writes
them as arrays sorted by hash.  Distinct left neighbours of each word are summed from those shards.  Scoring maps the arrays into memory
and looks every pair up by binary search, so no worker holds the model.  Contexts with a large share of all words are spread
over the shards by the pair.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, new_path, slim

U64 = np.uint64
#: Words in a chunk of counting and of scoring, word pairs that a shard gets about, words of the sample that finds hot contexts.
CHUNK, PER_SHARD, LOOK = 1 << 20, 1 << 21, 1 << 20
#: They hold white space, so they are no words.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n</s>", b"\n<s>"))


class _Ids(dict):
    """Word -> number in this chunk."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def hashes(self) -> np.ndarray:
        """In the order of the numbers; the marks of start and end stand for themselves."""
        return np.fromiter((w if isinstance(w, int) else xxhash.xxh3_64_intdigest(w) for w in self), np.uint64, len(self))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(31))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(29))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _home(a: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of pairs: by context, for hot contexts by pair."""
    spread = np.isin(a, hot) if len(hot) else np.zeros(len(a), bool)
    return _shard(np.where(spread, pair, a), shards)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    n, sizes = int.from_bytes(blob[:8], "little"), [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(blob[8:], n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t, size in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _counted(batches: Iterator[pa.RecordBatch], hot: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Blobs (context, word, count) of each chunk, one for each shard."""

    def blobs(ids: _Ids, left: list, right: list) -> pa.RecordBatch:
        h = ids.hashes()
        code, count = np.unique(np.concatenate(left).astype(np.int64) << 32 | np.concatenate(right), return_counts=True)
        a, b = h[code >> 32], h[code & 0xFFFFFFFF]
        home = _home(a, _pair(a, b), hot, shards)
        order = np.lexsort((b, a, home))
        a, b, count, home = a[order], b[order], count[order].astype(np.uint32), home[order]
        at = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
        parts = [_contexts(a[i:j], b[i:j], count[i:j]) for i, j in zip(at, [*at[1:], len(home)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(home[at], pa.int64()), pa.array(parts, pa.binary())], ["shard", "blob"])

    ids, left, right, n = _Ids(), [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held_out(d):
                continue
            words = _words(t.as_py())
            for i in range(0, len(words) + 1, CHUNK):
                some = [words[i - 1] if i else START, *words[i : i + CHUNK]]
                if i + CHUNK > len(words):
                    some.append(END)
                seq = np.fromiter(map(ids.__getitem__, some), np.int64, len(some))
                left.append(seq[:-1])
                right.append(seq[1:])
                n += len(seq)
                if n >= CHUNK:
                    yield blobs(ids, left, right)
                    ids, left, right, n = _Ids(), [], [], 0
    if n:
        yield blobs(ids, left, right)


def _contexts(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> bytes:
    at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    head = _pack(a[at], np.diff(np.append(at, len(a))).astype(np.uint32))
    return len(head).to_bytes(8, "little") + head + _pack(b, count)


def _read_contexts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int.from_bytes(blob[:8], "little")
    a, fan = _unpack(blob[8 : 8 + k], np.uint64, np.uint32)
    b, count = _unpack(blob[8 + k :], np.uint64, np.uint32)
    return np.repeat(a, fan), b, count


def _put(folder: str, name: str, data: bytes) -> None:
    own = f"{folder}/{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, f"{folder}/{name}")


def _few(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _merged(table: pa.Table, folder: str, hot: np.ndarray, shards: int) -> pa.Table:
    """One shard of contexts: writes its arrays and returns the left-neighbour counts of its words, by the words' shards."""
    shard = table.column("shard")[0].as_py()
    a, b, count = (np.concatenate(x) for x in zip(*(_read_contexts(x.as_py()) for x in table.column("blob")), strict=True))
    g = _pair(a, b)
    order = np.argsort(g)
    g = g[order]
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    g, a, b, count = g[at], a[order[at]], b[order[at]], np.add.reduceat(count[order].astype(np.int64), at)
    big = np.flatnonzero(count >= 255)
    words, rank = np.unique(a, return_inverse=True)
    total = np.bincount(rank, count, len(words)).astype(np.int64)
    few = [np.bincount(rank, count == k if k < 3 else count > 2, len(words)).astype(np.uint32) for k in (1, 2, 3)]
    spread = np.isin(words, hot)
    _put(folder, f"{shard}.pairs", g.tobytes())
    _put(folder, f"{shard}.counts", np.minimum(count, 255).astype(np.uint8).tobytes())
    _put(folder, f"{shard}.big", np.stack([big, count[big]]).astype(np.int64).tobytes())
    _put(folder, f"{shard}.words", words[~spread].tobytes())
    _put(folder, f"{shard}.totals", total[~spread].tobytes())
    _put(folder, f"{shard}.few", np.stack([f[~spread] for f in few]).tobytes())
    own = {str(w): [int(total[i]), *(int(f[i]) for f in few)] for i in np.flatnonzero(spread) for w in words[i : i + 1]}
    vocabulary = int((~spread & (words != U64(START))).sum())
    tokens = int(total[~spread & (words != U64(START))].sum())
    _put(folder, f"{shard}.json", json.dumps({"few": _few(count), "hot": own, "vocabulary": vocabulary, "tokens": tokens, "starts": int(total[~spread & (words == U64(START))].sum())}).encode())
    right, left = np.unique(b, return_counts=True)
    to = _shard(right, shards)
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    ends = [*at[1:], len(to)]
    return pa.table({"shard": pa.array(to[at], pa.int64()), "blob": pa.array([_pack(right[i:j], left[i:j].astype(np.uint32)) for i, j in zip(at, ends, strict=True)], pa.binary())})


def _continued(table: pa.Table, folder: str) -> pa.Table:
    """One shard of words: their counts of distinct left neighbours."""
    shard = table.column("shard")[0].as_py()
    w, c = (np.concatenate(x) for x in zip(*(_unpack(x.as_py(), np.uint64, np.uint32) for x in table.column("blob")), strict=True))
    words, rank = np.unique(w, return_inverse=True)
    count = np.bincount(rank, c, len(words)).astype(np.int64)
    _put(folder, f"{shard}.rights", words.tobytes())
    _put(folder, f"{shard}.lefts", count.tobytes())
    return pa.table({"shard": pa.array([shard], pa.int64()), "types": pa.array([int(count.sum())], pa.int64()), "words": pa.array([len(words)], pa.int64()), "few": pa.array([_few(count)], pa.list_(pa.int64()))})


def _discounts(few: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of counts 1 to 4; with too few to estimate, fixed ones."""
    n1, n2, n3, n4 = few
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(k, max(0.0, d)) if d == d else k / 2 for k, d in zip((1, 2, 3), found, strict=True)]


def train(docs: DataFrame, shards: int | None = None) -> dict:
    """Fit on the rows of docs (doc_id, text) that are not held out; returns what a scorer needs: the folder, counts and discounts.

    What comes to the driver: one line of counts for each shard and for each hot context of each shard.
    """
    spark = slim(docs).sparkSession
    uri = new_path(spark, "kneser-ney")
    folder = local_path(uri)
    os.makedirs(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).first()
    chars = size["c"] or 0
    shards = shards or max(1, min(1 << 20, -(-chars // (6 * PER_SHARD))))
    # A sample of about LOOK words decides where pairs are stored, never what is counted.
    part = min(1.0, 6 * LOOK / max(1, chars))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                seen.update(_words(t.as_py()))
                if len(seen) > 400_000:
                    seen = Counter(dict(seen.most_common(100_000)))
        top = seen.most_common(1000)
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(w) - (1 << 63) for w, _ in top], pa.int64()), pa.array([c for _, c in top], pa.int64())], ["h", "c"])

    seen = docs.sample(part, seed=1).mapInArrow(frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(200).collect()
    total = max(1, part * chars / 6)
    hot = np.array(sorted([START, *(r["h"] + (1 << 63) for r in seen if r["c"] > total / (8 * shards) and r["c"] > total / 400)]), np.uint64)
    counted = docs.mapInArrow(lambda it: _counted(it, hot, shards), "shard long, blob binary")
    lefts = counted.groupBy("shard").applyInArrow(lambda t: _merged(t, folder, hot, shards), "shard long, blob binary")
    done = lefts.groupBy("shard").applyInArrow(lambda t: _continued(t, folder), "shard long, types long, words long, few array<long>").collect()
    own = []
    for s in range(shards):
        if os.path.exists(f"{folder}/{s}.json"):
            with open(f"{folder}/{s}.json") as f:
                own.append(json.load(f))
    hots: dict[int, list[int]] = {}
    for o in own:
        for w, c in o["hot"].items():
            hots[int(w)] = [x + y for x, y in zip(hots.get(int(w), [0] * 4), c, strict=True)]
    starts = hots.get(START, [0])[0]
    words = sum(o["vocabulary"] for o in own) + len([w for w in hots if w != START])
    tokens = sum(o["tokens"] for o in own) + sum(c[0] for w, c in hots.items() if w != START)
    few = lambda xs: [sum(x[i] for x in xs) for i in range(4)]
    return {
        "folder": folder, "uri": uri, "shards": shards, "hot": hots, "documents": starts, "tokens": tokens + starts, "vocabulary": words + bool(starts),
        "discounts": _discounts(few([o["few"] for o in own])), "left_discounts": _discounts(few([r["few"] for r in done])), "types": sum(r["types"] for r in done), "left_few": few([r["few"] for r in done]), "rights": sum(r["words"] for r in done),
    }


class Model:
    """The arrays of train(), mapped into memory."""

    def __init__(self, meta: dict):
        self.meta, self.maps = meta, {}
        self.hot = np.array(sorted(meta["hot"]), np.uint64)
        self.hot_stats = np.array([meta["hot"][w] for w in sorted(meta["hot"])], np.int64).reshape(-1, 4)
        d1, d2, d3 = meta["left_discounts"]
        n1, n2, _, _ = meta["left_few"]
        self.left = np.array([0.0, d1, d2, d3])
        types = meta["types"]
        free = (d1 * n1 + d2 * n2 + d3 * (meta["rights"] - n1 - n2)) / types if types else 1.0
        self.unseen = free / (meta["vocabulary"] + 1)

    def _map(self, name: str, kind: type, rows: int = 1) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.meta['folder']}/{name}"
            empty = not os.path.exists(path) or not os.path.getsize(path)
            m = np.zeros(0, kind) if empty else np.memmap(path, kind, "r")
            self.maps[name] = m.reshape(rows, -1) if rows > 1 else m
        return self.maps[name]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted wanted are among the sorted keys, and where."""
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct sorted hashes: count, numbers of right neighbours seen once, twice, more; distinct left neighbours."""
        total, few, lefts = np.zeros(len(h), np.int64), np.zeros((3, len(h)), np.int64), np.zeros(len(h), np.int64)
        home = _shard(h, self.meta["shards"])
        for s in np.unique(home):
            i, j = np.searchsorted(home, [s, s + 1])
            found, at = self._find(self._map(f"{s}.words", np.uint64), h[i:j])
            if found.any():
                total[i:j][found] = self._map(f"{s}.totals", np.int64)[at[found]]
                few[:, i:j][:, found] = self._map(f"{s}.few", np.uint32, 3)[:, at[found]]
            found, at = self._find(self._map(f"{s}.rights", np.uint64), h[i:j])
            if found.any():
                lefts[i:j][found] = self._map(f"{s}.lefts", np.int64)[at[found]]
        found, at = self._find(self.hot, h)
        total[found], few[:, found] = self.hot_stats[at[found], 0], self.hot_stats[at[found], 1:].T
        total[h == U64(END)] = self.meta["documents"]
        return total, few, lefts

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        g = _pair(a, b)
        home = _home(a, g, self.hot, self.meta["shards"])
        order = np.lexsort((g, home))
        g, home, out = g[order], home[order], np.zeros(len(g), np.int64)
        for s in np.unique(home):
            i, j = np.searchsorted(home, [s, s + 1])
            found, at = self._find(self._map(f"{s}.pairs", np.uint64), g[i:j])
            if found.any():
                c = self._map(f"{s}.counts", np.uint8)[at[found]].astype(np.int64)
                if (c == 255).any():
                    where, count = self._map(f"{s}.big", np.int64, 2)
                    c[c == 255] = count[np.searchsorted(where, at[found][c == 255])]
                out[i:j][found] = c
        back = np.empty_like(out)
        back[order] = out
        return back

    def log10(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of ids[1:] after the one before it: log10 probability, count in training, log10 of the add-one estimate.  h: the hashes of the ids."""
        meta, (d1, d2, d3) = self.meta, self.meta["discounts"]
        order = np.argsort(h)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        total, few, lefts = (x[..., back] for x in self.words(h[order]))
        low = (lefts - self.left[np.minimum(lefts, 3)]) / max(1, meta["types"]) + self.unseen
        context = total.copy()
        context[h == U64(END)] = 0
        free = np.where(context > 0, (d1 * few[0] + d2 * few[1] + d3 * few[2]) / np.maximum(context, 1), 1.0)
        code, back = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)
        a, b = code >> 32, code & 0xFFFFFFFF
        c = self.pairs(h[a], h[b])
        p = np.maximum(c - np.array([0.0, d1, d2, d3])[np.minimum(c, 3)], 0) / np.maximum(context[a], 1) + free[a] * low[b]
        add_one = np.log10((total[b] + 1) / (meta["tokens"] + meta["vocabulary"] + 1))
        return np.log10(p)[back], total[b][back], add_one[back]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scored(batches: Iterator[pa.RecordBatch], meta: dict) -> Iterator[pa.RecordBatch]:
    model = Model(meta)

    def flush(ids: _Ids, seqs: list[np.ndarray], owners: list[int], sums: np.ndarray) -> None:
        """Add a chunk's sums to its documents.  A START between sequences is no word: what falls on the first of each is left out."""
        flat = np.concatenate(seqs)
        p, c, base = model.log10(flat, ids.hashes())
        lengths = [len(s) for s in seqs]
        owner = np.repeat(owners, lengths)[1:]
        keep = np.ones(len(flat), bool)
        keep[np.cumsum([0, *lengths[:-1]])] = False
        keep = keep[1:]
        for i, x in enumerate((np.ones(len(p)), c > 0, base, p)):
            sums[i] += np.bincount(owner[keep], x[keep], sums.shape[1])

    for batch in batches:
        docs = batch.column(0).to_pylist()
        sums = np.zeros((4, len(docs)))
        ids, seqs, owners, n = _Ids(), [], [], 0
        for row, t in enumerate(batch.column(1)):
            words = _words(t.as_py())
            for i in range(0, len(words) + 1, CHUNK // 4):
                some = [words[i - 1] if i else START, *words[i : i + CHUNK // 4]]
                if i + CHUNK // 4 > len(words):
                    some.append(END)
                seqs.append(np.fromiter(map(ids.__getitem__, some), np.int64, len(some)))
                owners.append(row)
                n += len(some)
                if n >= CHUNK // 4:
                    flush(ids, seqs, owners, sums)
                    ids, seqs, owners, n = _Ids(), [], [], 0
        if seqs:
            flush(ids, seqs, owners, sums)
        k, known = sums[0].astype(np.int64), sums[1].astype(np.int64)
        arrays = [pa.array(docs, pa.int64()), pa.array([held_out(d) for d in docs]), pa.array(k), pa.array(known), pa.array(np.full(len(docs), meta["tokens"], np.int64)), pa.array(sums[2]), pa.array(sums[3]), pa.array(np.power(10.0, np.minimum(300.0, -sums[3] / np.maximum(k, 1))))]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCORES.split(", ")])


def score(docs: DataFrame, meta: dict) -> DataFrame:
    """Every row of docs (doc_id, text) with its log10 probability under the model of train(), the add-one score and perplexity."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, meta), SCORES)


def perplexities(docs: DataFrame) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) mod 7 is not 2, and score all of docs (doc_id, text).

    A-Z are lower-cased; words are runs of anything but ASCII white space, then one end, which counts as a word.  Null text is empty and has the end only; a null id is the
    empty text for the fold.  Rows that repeat are counted and scored each.  An empty table gives no rows; with nothing to learn from, all words are equally likely.  Other columns are
    not looked at.  base_score is the add-one unigram log10 probability, score that of the interpolated modified Kneser-Ney pair model, whose vocabulary is open by one.
    """
    return score(docs, train(docs))

