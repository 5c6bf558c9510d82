"""Secret scans with corpus-wide ownership frequency.

Detectors find candidate spans in whole texts; the hash of each candidate is counted by distinct
repositories and owners.  What many owners hold is a widely copied example; what one owner holds and looks
random is taken for live.  DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: kind -> (pattern, group with the secret, least length of that group).  The first three are the base kinds, in order.
DETECTORS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 24),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "google": (r"AIza[A-Za-z0-9_-]{30,}", 0, 34),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", 0, 24),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 31),
}
BASE = ("assign", "access", "hex")
#: Cheap necessary conditions, so that most texts are passed over.
HINTS = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}
SPAN = "array<struct<start:long,rank:int,kind:string,end:long,hash:long,random:boolean>>"


def spans(text: Column, kind: str) -> Column:
    """The spans of one kind, leftmost and non-overlapping, in code points: gaps and matches alternate, so their
    summed lengths are positions.  hash identifies the secret; random: it has 10 or more different characters, with digits."""
    pattern, group, least = DETECTORS[kind]
    rank = list(DETECTORS).index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = matches if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), secrets.alias("secret"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(F.char_length(p["match"]), F.lit(0))
        random = (F.size(F.array_distinct(F.split(p["secret"], ""))) >= 10) & p["secret"].rlike("[0-9]")
        new = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(p["secret"]).alias("hash"), random.alias("random"))
        return F.struct(end.alias("at"), F.when(F.char_length(p["secret"]) >= least, F.concat(acc["found"], F.array(new))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pairs, start, add, lambda acc: acc["found"])
    return F.when(text.rlike(HINTS.get(kind, pattern)), found).otherwise(F.array().cast(SPAN))


def _joined(found: Column, test=None) -> Column:
    chosen = found if test is None else F.filter(found, test)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, most_owners: int = 2, most_repositories: int = 4) -> DataFrame:
    """Every row of docs (doc_id, owner, repository, text) with its spans and what ownership says of them.

    A candidate is copied if more than ``most_owners`` owners or ``most_repositories`` repositories hold it, otherwise live if it looks
    random, otherwise weak.  Null text is empty; a null owner or repository is one of its own.  Counts are over rows of all
    documents: rows that repeat count again for spans, not for owners.  Candidates are reduced to distinct (hash, owner, repository) before they are counted, so a widely
    copied example is no hot group.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.sort_array(F.concat(*[spans(text, k) for k in DETECTORS]))
    rows = docs.select("doc_id", "owner", "repository", found.alias("found")).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "spans")
    holders = rows.select("owner", "repository", F.explode(F.transform("found", lambda s: s["hash"])).alias("hash")).distinct()
    owned = holders.groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    # Written first, so that Spark can split the join on a hash that a large share of all rows has.
    wide = save(owned.where((F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)).select(F.col("hash").alias("wide")), "copied")
    each = rows.select("row", F.explode("found").alias("s")).join(wide, F.col("s.hash") == F.col("wide"), "left")
    copied = each.where("wide is not null").groupBy("row").agg(F.collect_set("wide").alias("wide"))
    out = rows.join(copied, "row", "left").withColumn("wide", F.coalesce("wide", F.array().cast("array<long>")))
    copied_in = lambda s: F.array_contains("wide", s["hash"])
    live = lambda s: ~copied_in(s) & s["random"]
    of = lambda kind: lambda s: s["kind"] == kind
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return out.select(
        "doc_id",
        *[count(of(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("found"), lambda s: s["rank"] < len(BASE)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        count(copied_in).alias("n_copied"),
        count(live).alias("n_live"),
        _joined(F.col("found"), live).alias("live_spans"),
    )
