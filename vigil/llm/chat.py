"""Chat formatting of reply trees.

Messages name the message that they answer.  Self-joins over doubling distances enumerate
every root-to-leaf path, branches are ranked by score, and each chosen path becomes one
conversation with its loss mask.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and other common templates.  Inside texts a backslash follows their first character,
#: one more for each that is already there, so that unescape() restores every text.
_TAIL = r"(/?s>|/?INST\]|\|[A-Za-z_]+\|>|</?SYS>>)"
_HEAD = r"([<\[])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_HEAD}(\\*){_TAIL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_HEAD}\\(\\*){_TAIL}", r"$1$2$3")


def _role(role: Column) -> Column:
    """A role stands on one line of its own."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, id, parent, ord) -> (tree, leaf, id, up): each root-to-leaf path, up counting from the leaf.

    A parent that is null, missing or not of a smaller ord than its child makes the child a root, so there are no cycles.
    Rounds: the logarithm of the depth.  Only keys are joined, and each round is written to the shared folder.
    """
    nodes = messages.select("tree", "id", "parent", "ord")
    known = nodes.select(F.col("tree").alias("t"), F.col("id").alias("p"), F.col("ord").alias("o"))
    same = F.col("tree").eqNullSafe(F.col("t"))
    up = nodes.join(known, same & (F.col("parent") == F.col("p")) & (F.col("o") < F.col("ord"))).select("tree", "id", F.col("p").alias("above")).distinct()
    up = save(up, "parents")
    inner = up.select(F.col("tree").alias("t"), F.col("above").alias("p")).distinct()
    leaves = nodes.select("tree", "id").distinct().join(inner, same & (F.col("id") == F.col("p")), "left_anti")
    found = save(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "paths")
    far = 1
    while not up.isEmpty():
        step = up.select(F.col("tree").alias("t"), F.col("id").alias("p"), "above")
        higher = found.join(step, same & (F.col("id") == F.col("p"))).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + far).alias("up"))
        found = save(found.unionByName(higher), "paths")
        up = save(up.join(step.withColumnRenamed("above", "top"), same & (F.col("above") == F.col("p"))).select("tree", "id", F.col("top").alias("above")), "parents")
        far *= 2
    return found


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, id, parent, ord, role, text, score) -> one row per chosen path.

    tree, leaf, rank, score (mean over the path, null scores 0), n_turns, formatted, and loss: the spans (start, end in
    code points of formatted) of the assistant's texts.  Paths rank by score, then leaf; the first ``best`` of each tree are
    formatted, or all.  Null text and role are empty; a null tree is a tree; rows that repeat an id of their tree all stand in its place, ordered by role and text.
    A path becomes one string, so its length must fit a row; other columns are not looked at.
    """
    keep = messages.select("tree", "id", "parent", "ord", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    on = paths(keep)
    scored = on.alias("a").join(keep.select("tree", "id", "score").alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.id") == F.col("b.id")))
    scored = scored.groupBy("a.tree", "leaf").agg(F.avg("score").alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    rows = on.alias("a").join(ranked.alias("r"), F.col("a.tree").eqNullSafe(F.col("r.tree")) & (F.col("a.leaf") == F.col("r.leaf")))
    rows = rows.select("a.tree", "a.leaf", "rank", "mean", "a.id", "up").alias("p").join(keep.alias("m"), F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.id") == F.col("m.id")))
    head = F.concat(F.lit(TURN), _role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("up")).alias("at"), F.col("role"), head.alias("head"), body.alias("body"), F.char_length(head).alias("h"), F.char_length(body).alias("b"))
    turns = rows.groupBy("p.tree", "leaf", "rank").agg(F.first("mean").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    ends = len(END)

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["h"]
        span = F.array(F.struct(begin.alias("start"), (begin + t["b"]).alias("end")))
        return F.struct((begin + t["b"] + ends).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    loss = F.aggregate("turns", start, add, lambda acc: acc["spans"])
    return turns.select("tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(piece, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit("\n"))
        text = F.substr(p, at + 1, F.char_length(p) - at - len(END))
        return F.struct(_role_back(F.substr(p, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chains(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages: each turn answers the one before it (ties by role and text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    out = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return out.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.col("id").alias("ord"), "role", "text", F.lit(1.0).alias("score"))
