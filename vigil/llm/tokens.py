"""Token ids in training order.

Documents are tokenised with a public vocabulary and packed into sequences of one length.  A keyed
Feistel permutation of the sequence numbers, walked along its cycles into the exact range, gives every sequence a global slot;
range partitions hold consecutive slots, and each shard is a file of fixed-stride records that is read in sequence and resumed at any slot.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_path, new_path, save, shuffles_removed, slim

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE, PER_SHARD, ROUNDS = 1024, 4096, 4
#: Range partitions of one shuffle at most; beyond as many shards a task writes several, one after the other.
PARTITIONS = 100_000
#: Shares of the shards that stored() shuffles and writes one after the other, each with a shuffle of its own that is deleted before the next.
SHARES = 2


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a balanced Feistel network over the next power of four; values beyond n are mapped again until they fall inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big")) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        return left << h | right

    out = once(np.asarray(x, np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PACKED = "part long, nth long, n_tokens long, doc_ids array<long>, body binary"


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: bytes, length: int, stop: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Documents one after the other, each closed by stop, cut into sequences; the last of a partition may be short."""
    enc, part, nth, kind = encoder(vocabulary), TaskContext.get().partitionId(), 0, np.uint32 if wide else np.uint16
    zstd = pa.Codec("zstd", compression_level=3)
    held, owners, out = np.zeros(0, kind), [], []

    def cut(ids: np.ndarray) -> None:
        nonlocal nth
        out.append((part, nth, len(ids), list(dict.fromkeys(owners)), zstd.compress(ids.tobytes(), asbytes=True)))
        nth += 1

    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "nth", "n_tokens", "doc_ids", "body"])
        out.clear()
        return done

    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(np.asarray(enc.encode_to_numpy(t.as_py() or "")), stop).astype(kind)
            owners.append(d)
            held = np.concatenate([held, ids])
            while len(held) >= length:
                cut(held[:length])
                held = held[length:]
                owners = [d] if len(held) else []
        if len(out) >= 256:
            yield flush()
    if len(held):
        cut(held)
    if out:
        yield flush()


def _placed(docs: DataFrame, tokenizer: str, length: int, per_shard: int, key: int) -> tuple[DataFrame, int, int]:
    """Compressed sequences with their slots, the number of all, and the end-of-text id."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read()
    stop = vocabulary.count(b"\n") + (not vocabulary.endswith(b"\n"))
    packed = save(slim(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _packed(it, vocabulary, length, stop, stop > 0xFFFF), PACKED), "tokens")
    counts = packed.groupBy("part").agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each input partition
    base = counts.select("part", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("base"))
    slot = F.pandas_udf(lambda s: pd.Series(feistel(s.to_numpy(np.int64), n, key)), "long")
    placed = packed.join(F.broadcast(base), "part").withColumn("slot", slot(F.col("base") + F.col("nth")))
    return placed.select("slot", F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), F.pmod("slot", F.lit(per_shard)).alias("place"), "n_tokens", "doc_ids", "body"), n, stop


def _ordered(placed: DataFrame, first: int, stop_before: int, stop: int, length: int) -> DataFrame:
    """The shards from first to before stop_before as range partitions of whole shards, sorted by slot, with the records as they are written.
    Shards are of one size, so their numbers are the bounds of the ranges."""
    wide, shards = stop > 0xFFFF, max(1, stop_before - first)
    each = -(-shards // PARTITIONS)
    own = placed.where((F.col("shard") >= first) & (F.col("shard") < stop_before))
    ranged = own.repartitionById(-(-shards // each), F.floor((F.col("shard") - first) / each).cast("int")).sortWithinPartitions("slot")
    size = 4 if wide else 2

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(length, stop, np.uint32 if wide else np.uint16).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                records = [pa.decompress(b, size * k, codec="zstd", asbytes=True) + pad[size * k :] for k, b in zip(some.column("n_tokens").to_pylist(), some.column("body").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("slot", "shard", "place", "n_tokens", "doc_ids")), pa.array(records, pa.binary())], ["slot", "shard", "place", "n_tokens", "doc_ids", "record"])

    return ranged.mapInArrow(unpacked, "slot long, shard long, place long, n_tokens long, doc_ids array<long>, record binary")


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = 1) -> DataFrame:
    """slot, shard, place, n_tokens, doc_ids and record of every sequence of docs (doc_id, text), range-partitioned and sorted by slot.

    record holds ``length`` little-endian ids (two bytes each, four for vocabularies beyond 65,535), padded with the end-of-text id behind n_tokens; every document ends
    with that id, and null text is empty.  doc_ids: the documents in a sequence, in order; a text of any length takes as many sequences as it needs.  Rows that repeat are written each.
    An empty table gives no rows; other columns are not looked at, whatever they are called.  Order within the corpus is that of the input's partitions, so equal inputs and splits give
    equal shards.  The token table is written once to the shared folder; only counts per partition are summed, and compressed sequences are shuffled once.
    """
    placed, n, stop = _placed(docs, tokenizer, length, per_shard, key)
    return _ordered(placed, 0, -(-n // per_shard), stop, length)


MANIFEST = "shard long, path string, first_slot long, records long, bytes long, sha256 string, n_tokens array<long>, doc_ids array<array<long>>"


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the records of sequences() as folder/shard-N.bin, N the shard: record ``place`` starts at place * stride.

    One row per shard in folder: shard, path, first_slot, records, bytes, sha256, and n_tokens and doc_ids of its records in order, which stands beside the shard as shard-N.parquet.  folder must
    be mounted on every host.  A task writes whole shards to files of its own and renames them, the row last, so retries and lost executors leave whole files only.
    """
    to = local_path(folder)
    os.makedirs(to, exist_ok=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        now, done = None, 0

        def close() -> None:
            shard, f, path, first, n, size, digest, lengths, owners = now
            f.close()
            os.replace(f.name, path)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
            row = (shard, path, first, n, size, digest.hexdigest(), lengths, owners)
            pq.write_table(pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["shard", "path", "first_slot", "records", "bytes", "sha256", "n_tokens", "doc_ids"]), f.name, compression="zstd")
            os.replace(f.name, f"{path.removesuffix('.bin')}.parquet")

        for batch in batches:
            for shard, slot, record, k, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "record", "n_tokens", "doc_ids")), strict=True):
                if now is None or now[0] != shard:
                    if now is not None:
                        close()
                    path, done = f"{to}/shard-{shard:08d}.bin", done + 1
                    now = [shard, open(f"{to}/_{shard:08d}.{os.getpid()}.{TaskContext.get().taskAttemptId()}", "wb"), path, slot, 0, 0, hashlib.sha256(), [], []]  # noqa: SIM115
                now[1].write(record)
                now[4] += 1
                now[5] += len(record)
                now[6].update(record)
                now[7].append(k)
                now[8].append(ids)
        if now is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["shards"])

    spark = ordered.sparkSession
    with shuffles_removed(spark):
        ordered.mapInArrow(written, "shards long").agg(F.sum("shards")).collect()
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.parquet").parquet(folder)


def read_shards(manifest: DataFrame) -> DataFrame:
    """The rows of sequences() from the files that manifest (of write_shards) names, range-partitioned and sorted by slot.  A file that is not as the manifest says is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "shard", "place", "n_tokens", "doc_ids", "record"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, stride, digest = row["records"], row["bytes"] // row["records"], hashlib.sha256()
                with open(row["path"], "rb") as f:
                    for at in range(0, n, 1024):
                        k = min(1024, n - at)
                        digest.update(data := f.read(k * stride))
                        if len(data) < k * stride or at + k == n and (f.read(1) or digest.hexdigest() != row["sha256"]):
                            raise ValueError(f"{row['path']} is not as written")
                        place = np.arange(at, at + k)
                        records = [data[j : j + stride] for j in range(0, k * stride, stride)]
                        columns = (pa.array(row["first_slot"] + place), pa.array(np.full(k, row["shard"])), pa.array(place), pa.array(row["n_tokens"][at : at + k], pa.int64()), pa.array(row["doc_ids"][at : at + k], pa.list_(pa.int64())), pa.array(records, pa.binary()))
                        yield pa.RecordBatch.from_arrays(list(columns), names)

    shards = max(1, manifest.count())
    each = -(-shards // PARTITIONS)
    return manifest.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard").mapInArrow(read, "slot long, shard long, place long, n_tokens long, doc_ids array<long>, record binary")


def stored(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = SEQUENCE, per_shard: int = PER_SHARD, key: int = 1) -> DataFrame:
    """The rows of sequences(), written as shards to a new folder of the shared one and read back from these files; see there for odd rows."""
    folder = new_path(docs.sparkSession, "token-shards")
    placed, n, stop = _placed(docs, tokenizer, length, per_shard, key)
    shards = -(-n // per_shard)
    for i in range(SHARES):
        manifest = write_shards(_ordered(placed, i * shards // SHARES, (i + 1) * shards // SHARES, stop, length), folder)
    return read_shards(manifest)


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE, per_shard: int = PER_SHARD, wide: bool = False) -> Iterator[np.ndarray]:
    """The sequences of slots first, first + 1, ... read in sequence; resume by giving the next slot."""
    kind, to = np.dtype("<u4" if wide else "<u2"), local_path(folder)
    for slot in range(first, first + count):
        with open(f"{to}/shard-{slot // per_shard:08d}.bin", "rb") as f:
            f.seek(slot % per_shard * length * kind.itemsize)
            yield np.frombuffer(f.read(length * kind.itemsize), kind)
