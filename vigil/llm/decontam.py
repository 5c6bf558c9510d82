"""Benchmark decontamination by SimHash of item-sized windows.

A window as long as a benchmark item gets a 64-bit SimHash of its word shingles.  Fingerprints are cut into 13 blocks; two within
25 bits agree in some block up to one bit, so a join on the blocks and their one-bit neighbours finds every pair within the radius, and the
exact similarity of the weighted shingles (weight: occurrences) decides.  Windows that hold too few of an item's shingles for
the similarity asked for are not formed: that bound is exact.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, save, unused

WIDTH = 5
#: Bits that the fingerprints of a window and an item may differ in; similarity 0.8 differs in 10 on average, 24 is five deviations more.
RADIUS, BLOCKS = 24, 13
#: Item shingles (or words, or entries of the index) that may be broadcast, 40 bytes each at most beside the words' own letters; more are joined by a shuffle.
BROADCAST = 1_000_000
_CUTS = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS) for b in range(BLOCKS)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), "")


def _at(w: Column, i: Column, width: int) -> list[Column]:
    return [F.get(w, i + k) for k in range(width)]


def _positions(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _shingles(w: Column, n: Column, width: int) -> Column:
    """Shingles as strings; the nth occurrence of one is marked as such, so that sets compare weights."""
    sorted_ = F.sort_array(F.transform(_positions(n, width), lambda i: F.concat_ws(" ", *_at(w, i, width))))
    return let(sorted_, lambda raw: F.transform(raw, lambda s, i: F.concat_ws("\n", s, (i - F.array_position(raw, s)).cast("string"))))


def _simhash(h: Column, n: Column, planes: int) -> Column:
    """The bits that more than half of the n hashes have.  Counts of all 64 bits are kept at once, one long for each binary digit."""
    names = [f"p{i}" for i in range(planes)]
    zero = F.struct(*[F.lit(0).cast("long").alias(p) for p in names])

    def add(acc: Column, x: Column) -> Column:
        carry, out = x, []
        for p in names:
            out.append(acc[p].bitwiseXOR(carry).alias(p))
            carry = acc[p].bitwiseAND(carry)
        return F.struct(*out)

    least = F.shiftright(n, 1).cast("long") + 1

    def majority(acc: Column) -> Column:
        above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for i in reversed(range(planes)):
            digit = -(F.shiftright(least, i).bitwiseAND(F.lit(1)))
            c = acc[names[i]]
            above = above.bitwiseOR(equal.bitwiseAND(c).bitwiseAND(F.bitwise_not(digit)))
            equal = equal.bitwiseAND(F.bitwise_not(c.bitwiseXOR(digit)))
        return above.bitwiseOR(equal)

    return F.aggregate(h, zero, add, majority)


def _block(f: Column, b: int) -> Column:
    low, high = _CUTS[b]
    return F.shiftrightunsigned(f, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _neighbour(f: Column, b: int, flip: int) -> Column:
    return _block(f, b).bitwiseXOR(F.lit(flip))


def _hashes(w: Column, n: Column, width: int) -> Column:
    return F.transform(_positions(n, width), lambda i: F.xxhash64(*_at(w, i, width)))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS, by_row: bool = False) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row for each document and item that it holds: doc_id, item_id, start (word), n_words and similarity of the best window.

    A window has as many words as the item, or the whole document if that is shorter; it holds the item if 100 * sum of the lesser weights >= percent * sum of the greater, over shingles of
    five words (items of fewer words: all of them).  Words are lower-cased runs of anything but ASCII white space.  Null and blank texts hold nothing and
    blank items are held by nothing.  Rows that repeat a doc_id or item_id are examined each and returned once; ties go to the first window.  Null ids are returned as null.  Empty
    tables give no rows; other columns are not looked at.  With ``by_row`` rows that repeat a doc_id with other text are returned each, and row is a hash of the text.
    """
    if radius >= 2 * BLOCKS:
        raise ValueError(f"the blocks guarantee a radius below {2 * BLOCKS}")
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = save(items.withColumn("width", F.least("n", F.lit(WIDTH))), "items")
    shape = items.agg(F.collect_set("width").alias("widths"), F.max("n").alias("most"), F.count("*").alias("items"), F.sum(F.col("n") - F.col("width") + 1).alias("shingles")).first()
    planes = max(1, int(shape["most"] or 0).bit_length())
    # Each item has 77 entries of 40 bytes in the index and its words are at most as many as its shingles and four more.
    small = (shape["shingles"] or 0) + 4 * (shape["items"] or 0) <= BROADCAST
    broad = F.broadcast if small else (lambda df: df)
    sent = F.broadcast if small and 77 * (shape["items"] or 0) <= BROADCAST else (lambda df: df)
    own_id = ["doc_id", "row"] if by_row else ["doc_id"]
    out = None
    for width in sorted(shape["widths"] or [WIDTH]):
        own = items.where(F.col("width") == width).withColumn("m", F.col("n") - width + 1)
        # 100 o >= p (m + k - o), m and k shingles of item and window: o >= p (m + k) / (100 + p).
        known = own.select("item_id", "n", "m", F.explode(F.array_distinct(_hashes(F.col("w"), F.col("n"), width))).alias("hash"))
        hashes = let(words(F.col("text")), lambda w: _hashes(w, F.size(w), width))  # noqa: B023
        texts = docs.select("doc_id", F.xxhash64("text").alias("row"), hashes.alias("hashes")).withColumn("size", F.size("hashes") + width - 1)
        # The outer forms keep Spark from computing the arrays once more to filter empty ones.
        seen = texts.select("doc_id", "row", "size", F.posexplode_outer("hashes").alias("pos", "hash"))
        hits = seen.join(broad(known), "hash").groupBy("doc_id", "row", "size", "item_id", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
        length = F.least("n", "size")
        k = length - width + 1
        need = F.ceil(F.lit(percent) * (F.col("m") + k) / (100 + percent)).cast("int")
        enough = lambda p, i: F.get("hits", i + need - 1) <= p + k - 1  # noqa: E731, B023
        # A window that holds enough can start at the first of its hits, or end with the document.
        starts = F.array_distinct(F.transform(F.filter("hits", enough), lambda p: F.least(p, F.col("size") - length)))
        windows = hits.select("doc_id", "row", length.alias("length"), "n", F.explode(starts).alias("start"))
        asked = windows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "length", "n")).alias("windows"))
        chosen = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
        found = chosen.alias("d").join(asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.row") == F.col("a.row")))
        cut = lambda w: F.transform("windows", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["length"].alias("length"), F.slice(w, x["start"] + 1, x["length"]).alias("w")))
        found = found.select(*[f"d.{c}" for c in own_id], F.explode_outer(let(words(F.col("text")), cut)).alias("x")).select(*own_id, "x.*")
        prints = lambda df: df.withColumn("print", _simhash(_hashes(F.col("w"), F.size("w"), width), F.size("w") - width + 1, planes))  # noqa: E731, B023
        found = save(prints(found), "windows")
        blocks = lambda values: F.explode(F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in values]))
        near = [(b, x) for b, (low, high) in enumerate(_CUTS) for x in (0, *(1 << i for i in range(high - low)))]
        marked = save(prints(own).select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("n").alias("item_n"), F.col("w").alias("item_w"), F.col("print").alias("item_print")), "item-prints")
        index = marked.select("item", F.col("item_n").alias("entry_n"), F.col("item_print").alias("entry_print"), blocks([(b, _neighbour(F.col("item_print"), b, x)) for b, x in near]).alias("b")).select("item", "entry_n", "entry_print", "b.block", "b.value")
        probes = found.select(*own_id, "start", "n", "length", "w", "print", blocks([(b, _block(F.col("print"), b)) for b in range(BLOCKS)]).alias("b")).select(*own_id, "start", "n", "length", "w", "print", "b.block", "b.value")
        apart = F.bit_count(F.col("print").bitwiseXOR(F.col("entry_print")))
        # Index entries are five numbers each; the words of an item are joined to the pairs within the radius.
        pairs = probes.alias("p").join(sent(index).alias("i"), (F.col("p.block") == F.col("i.block")) & (F.col("p.value") == F.col("i.value")) & (F.col("p.n") == F.col("i.entry_n")) & (apart <= radius))
        # Of the blocks in which a pair agrees, the first one answers for it.
        first = F.least(*[F.when(F.bit_count(_block(F.col("print").bitwiseXOR(F.col("entry_print")), b)) <= 1, F.lit(b)) for b in range(BLOCKS)])
        pairs = pairs.where(F.col("p.block") == first).select(*own_id, "start", "length", "w", "item")
        pairs = pairs.join(broad(marked.select("item", "item_id", "item_w")), "item")
        a, b = _shingles(F.col("w"), F.size("w"), width), _shingles(F.col("item_w"), F.size("item_w"), width)
        exact = pairs.select(*own_id, "item_id", "start", "length", F.size(F.array_intersect(a, b)).alias("both"), (F.size("w") + F.size("item_w") - 2 * (width - 1)).alias("all"))
        good = exact.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("all") - F.col("both")))
        rank = F.struct((F.col("both") / (F.col("all") - F.col("both"))).alias("similarity"), (-F.col("start")).alias("start"), "length")
        best = good.groupBy(*own_id, "item_id").agg(F.max(rank).alias("best"))
        best = best.select(*own_id, "item_id", (-F.col("best.start")).cast("long").alias("start"), F.col("best.length").cast("long").alias("n_words"), F.round("best.similarity", 6).alias("similarity"))
        out = best if out is None else out.unionByName(best)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item; of rows that share a doc_id, or have none, only those whose text holds one go.
    Null, empty and blank texts stay, as do all rows if the benchmark is empty; other columns come back as they are, whatever they are called."""
    own = unused("own", docs)
    gone = contaminated(docs.select("doc_id", "text"), benchmark, by_row=True).select(F.struct("doc_id", "row").alias(own)).distinct()
    return docs.withColumn(own, F.struct("doc_id", F.xxhash64("text").alias("row"))).join(gone, own, "left_anti").drop(own)
