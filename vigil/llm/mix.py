"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length and source.  A source that gets more than it
has is taken whole as often as fits; what remains of its budget is met by a bounded
knapsack over the lengths, and the documents of each length are then drawn by a
seeded hash.  Only length counts reach the knapsack, one source at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, unused, word_count

#: Salts that split the documents of one source and length.
SALTS = 512


def targets(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> the same with rank and target.

    Sources by code point, null last, take the weights in turn and share the sum of
    all sizes; a share stops at ``cap`` times the source's size and the excess goes to
    the others by weight until none is above.  The fixed point is min(cap * size,
    level * weight), so one pass over the sources in order of cap * size / weight finds
    the level.  One row per source goes through one task.
    """
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(whole) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    ordered = Window.orderBy(full / F.col("w"), "rank")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("w", weight)
        .withColumn("total", F.sum("source_size").over(after).cast("double"))
        .withColumn("capped", F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(after) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("try", (F.col("total") - F.col("capped")) / F.col("left_w"))
        .withColumn("ok", F.when(F.col("try") <= full / F.col("w"), F.col("try")))
        .withColumn("level", F.coalesce(F.first("ok", ignorenulls=True).over(after), F.lit(0.0)))
    )
    return level.select("source", "rank", "source_size", F.least(full, F.col("level") * F.col("w")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int | None = 1 << 16) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum as near to budget
    as the knapsack can, never above it.

    A share of every size is taken first, then the longest documents as long as more than ``window`` words are left; what remains is
    an exact bounded subset sum over all documents left.  With None the subset sum is exact over the whole budget, for nine bytes of memory a word.
    """
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not len(sizes):
        return taken
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    left = budget
    if window is not None and budget > window:
        taken = np.floor(counts * ((budget - window) / total)).astype(np.int64)
        left -= int((taken * sizes).sum())
        for i in order:
            k = min(int(counts[i] - taken[i]), max(0, left - window) // int(sizes[i]))
            taken[i] += k
            left -= k * int(sizes[i])
    if window is not None and left > 2 * window:
        # Every document left is longer than left - window, so one more fits at most.
        for i in order:
            if taken[i] < counts[i] and sizes[i] <= left:
                taken[i] += 1
                break
        return taken
    first = np.full(left + 1, -1, np.int64)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    items: list[tuple[int, int, int]] = []
    for i in order:
        size, have, k = int(sizes[i]), min(int(counts[i] - taken[i]), left // int(sizes[i])), 1
        while have > 0 and not reach[left]:
            k = min(k, have)
            step = k * size
            new = reach[: left + 1 - step] & ~reach[step:]
            first[step:][new] = len(items)
            reach[step:] |= new
            items.append((i, k, step))
            have, k = have - k, 2 * k
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k, step = items[first[at]]
        taken[i] += k
        at -= step
    return taken


def _planned(table: pa.Table, cap: int, window: int | None) -> pa.Table:
    """The knapsack of one source, over its length counts."""
    rank, size, n = (table.column(c).to_numpy() for c in ("rank", "size", "n"))
    whole_size, target = int(table.column("source_size")[0].as_py()), float(table.column("target")[0].as_py())
    whole = min(cap, int(target // whole_size)) if whole_size else 0
    rest = round(target - whole * whole_size) if whole < cap else 0
    extra = fit(size, n, rest, window)
    return pa.table({"rank": pa.array(rank, pa.int32()), "size": pa.array(size, pa.int64()), "whole": pa.array(np.full(len(size), whole), pa.int64()), "extra": pa.array(extra, pa.int64())})


def _drawn(docs: DataFrame, keys: list[str], weights: tuple[float, ...], cap: int, seed: int, window: int | None) -> DataFrame:
    """keys, size, source_size, target and copies of every row of docs (keys, source, text); the seeded hash is of doc_id, ties fall by the keys."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("h")
    sized = save(docs.select(*keys, "source", word_count(F.col("text")).alias("size"), h), "mix-sizes")
    goals = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    rows = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    rows = rows.select(*keys, "size", "h", "rank", "source_size", "target", F.pmod("h", F.lit(SALTS)).alias("salt"))
    counted = rows.where("size > 0").groupBy("rank", "size", "salt").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    salted = save(counted, "mix-counts", few=True)
    lengths = salted.groupBy("rank", "size").agg(F.sum("n").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    plan = lengths.groupBy("rank").applyInArrow(lambda t: _planned(t, cap, window), "rank int, size long, whole long, extra long")
    before = Window.partitionBy("rank", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plan, ["rank", "size"])
        .select("rank", "size", "salt", "whole", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("take"))
    )
    drawn = Window.partitionBy("rank", "size", "salt").orderBy("h", *keys)
    picked = rows.withColumn("nth", F.row_number().over(drawn)).join(shares, ["rank", "size", "salt"], "left")
    copies = F.coalesce(F.col("whole") + (F.col("nth") <= F.col("take")).cast("long"), F.lit(0)).cast("long")
    return picked.select(*keys, "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, window: int | None = 1 << 16) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of docs (doc_id, source, text).

    Null text has size 0; documents of size 0 are never taken.  Null sources are one source,
    last in order.  Rows that repeat a doc_id are documents of their own.  Ties in the seeded
    hash fall by doc_id.  Texts of any length are counted whole.  An empty table gives no rows.  Other columns are not looked at, whatever they are called.

    ``window``: words of a source's budget that the exact subset sum covers; None: all of it.  A budget beyond the window is met to the word unless the documents
    left over cannot fill what remains, which takes sources of few documents or of documents longer than the window.
    """
    out = _drawn(docs, ["doc_id"], weights, cap, seed, window)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, window: int | None = 1 << 16) -> DataFrame:
    """The rows of docs (doc_id, source, text and any others), each as often as mix() takes it.

    Null, empty and blank texts are never taken; rows that repeat a doc_id are taken each for itself, and of rows that are equal in doc_id, source and text it makes no difference which.
    Other columns come back as they are, whatever they are called; an empty table gives no rows.
    """
    # Rows meet their copies by doc_id, source and text; those equal in all are told apart by number.
    own, nth, each = unused("own", docs), unused("nth", docs), unused("each", docs)
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("row"))
    chosen = _drawn(docs.select("doc_id", "source", key.alias("to"), "text"), ["doc_id", "to"], weights, cap, seed, window).where("copies > 0")
    chosen = chosen.groupBy(F.col("to").alias(own)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(each))
    both = docs.withColumn(own, key).join(chosen, own)
    both = both.withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(F.lit(0)))).where(F.col(nth) <= F.size(each))
    both = both.withColumn(own, F.explode(F.sequence(F.lit(1), F.element_at(F.col(each), F.col(nth)).cast("int"))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
