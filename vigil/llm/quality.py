"""Quality classifier with hierarchical empirical Bayes.

A linear classifier on words, word starts and layout gives each document evidence of being low in quality and
of being toxic.  Grouped sums of that evidence give each host a posterior shrunk toward the whole corpus, and each path
of a host one shrunk toward its host; the strength of shrinkage is estimated from the spread between groups.  A document's
own evidence is then combined with the posterior of its path, in which it does not count itself.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slim, unused

#: Labelled documents that the classifier is fitted on at most (those of least hash); documents that must share a feature; deviations by which a feature has to
#: stand out between the labels.
SAMPLE, LEAST, DEVIATIONS = 8_000, 2, 3.0
#: The ridge of a feature that stands out by CLEAR deviations or more; one that stands out less is held back by this power of the shortfall.
RIDGE, CLEAR, POWER = 0.02, 5.0, 12
#: Bounds of the evidence and of what a site may add to it, in logits.
STRONG, SITE = 12.0, 2.0
HEADS = ("low", "toxic")
SYMBOLS, CAPITALS = string.punctuation.encode(), string.ascii_uppercase.encode()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class _Index(dict):
    """Word -> hashes of its features, or, with known, the numbers of those that are known."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def of(self, raw: bytes, seed: int) -> tuple[int, ...]:
        h = _signed(xxhash.xxh3_64_intdigest(raw, seed))
        return (h,) if self.known is None else (self.known[h],) if h in self.known else ()

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = self.of(word, 0) + self.of(word[:5], 1)
        return out


def features(text: str | None, index: _Index) -> list[int]:
    """The binary features of a whole text: its words, their starts, and its layout."""
    cased = (text or "").encode("utf-8", "surrogatepass")
    raw = cased.lower()
    words = raw.split()
    distinct = set(words)
    found = {f for w in distinct for f in index[w]}
    n = max(1, len(words))
    marks = sum(map(raw.count, (b"|", b"%", b"$", b"#", b"&", b"*", b"{", b"}", b"<", b">", b"=", b"@")))
    stops = sum(map(raw.count, (b".", b"!", b"?")))
    varied, size = int(9 * len(distinct) / n), min(14, n.bit_length())
    layout = {
        "empty": not words, "marks": min(9, int(20 * marks / n)), "varied": varied, "few": len(distinct) < 3 <= len(words), "long": min(12, len(raw) // n // 2),
        "stops": min(9, int(60 * stops / n)), "lines": min(9, int(40 * raw.count(b"\n") / n)), "size": size, "varied, size": (varied, size),
    }
    # Levels hold the lower ones, so that kinds of junk with a share of symbols or capitals speak for one another.
    levels = {"symbols": 4 * (len(raw) - len(raw.translate(None, SYMBOLS))) // n, "capitals": 8 * (len(cased) - len(cased.translate(None, CAPITALS))) // max(1, len(cased))}
    found.update(f for k, v in layout.items() for f in index.of(f"{k}={v}".encode(), 2))
    found.update(f for k, v in levels.items() for i in range(min(6, v)) for f in index.of(f"{k}>{i}".encode(), 2))
    return sorted(found)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = _Index()
    for batch in batches:
        rows = [features(t.as_py(), index) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("low"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "low", "toxic", "features"])


def _telling(sample: DataFrame, head: str, most: int | None) -> dict[int, float]:
    """The features whose share of positive documents stands out from the sample's, and by how many deviations."""
    base = sample.agg(F.count("*").alias("n"), F.avg(head).alias("p")).first()
    p = base["p"] or 0.0
    if not 0 < p < 1:
        return {}
    counts = sample.select(head, F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum(head).alias("k")).where(F.col("n") >= LEAST)
    z = F.abs(F.col("k") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    found = counts.withColumn("z", z).where(F.col("z") >= DEVIATIONS).orderBy(F.desc("z"), "f")
    return {r["f"]: r["z"] for r in (found if most is None else found.limit(most)).collect()}


def _fit(row: np.ndarray, col: np.ndarray, z: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of the features, which stand out by z deviations, and a bias: logistic regression on the whole sample, by Adam.  Document row[i] has feature col[i]."""
    size, ridge = len(z), RIDGE * np.maximum(1, CLEAR / np.maximum(z, DEVIATIONS / 2)) ** POWER
    if not 0 < y.sum() < len(y):
        return np.append(np.zeros(size), STRONG if len(y) and y.all() else -STRONG)
    v, b = np.zeros(size), np.log(y.mean() / (1 - y.mean()))
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, v[col], len(y)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g, gb = np.bincount(col, err[row], size) + ridge * v, err.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate, c1, c2 = 0.1 * (1 - t / (steps + 1)) + 0.005, 1 - 0.9**t, 1 - 0.99**t
        v -= rate * (m / c1) / (np.sqrt(s / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return np.append(v, b)


def _scored(batches: Iterator[pa.RecordBatch], known: dict[int, int], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    index = _Index(known)
    for batch in batches:
        z = np.array([weights[features(t.as_py(), index)].sum(axis=0) for t in batch.column("text")], np.float64).reshape(-1, len(HEADS)) + weights[-1]
        z = np.clip(z, -STRONG, STRONG)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("host"), batch.column("path"), *(pa.array(z[:, i]) for i in range(len(HEADS)))], ["doc_id", "row", "host", "path", *(f"z_{h}" for h in HEADS)])


def _p(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, head: str) -> tuple[float, float]:
    """Mean of the evidence and the strength of the prior, in documents: method of moments over the groups' means."""
    mean = F.col(f"s_{head}") / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum(f"s_{head}").alias("s"), F.sum(f"q_{head}").alias("q"), F.count("*").alias("k"), F.sum(mean * mean * F.col("n")).alias("mm")).first()
    if not r["n"]:
        return 0.5, 1.0
    mu = min(1 - 1e-6, max(1e-6, r["s"] / r["n"]))
    within = max(0.0, r["q"] - r["mm"]) / max(1, r["n"] - r["k"])
    between = max(0.0, r["mm"] / r["n"] - mu * mu - within * (r["k"] - 1) / r["n"])
    return mu, min(1e4, max(1.0, within / between if between > 0 else 1e4))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int | None = None) -> DataFrame:
    """Every row of docs (doc_id, host, path, text) with its evidence, its site's posteriors and kept.

    labels (doc_id, quality, toxic) may cover any part of docs; rows with a null label are passed over and at most ``sample`` labelled documents, those of least
    hash, are fitted on.  p_low and p_toxic are combined probabilities; kept: both are below one half.  Null text is empty; a null host or
    path is a site of its own.  Without labels of both kinds a head finds nothing, so all are kept.  Rows that repeat are scored each.
    ``most_features``: features that a head may use, those that stand out most; None: all that stand out, which the sample bounds.  Texts of any length are taken
    whole; a tie at one half is rejected; an empty table gives no rows.  Other columns are not looked at, whatever they are called.  Groups are summed before they are joined, and a hot host is split by its paths and by partial sums.
    """
    return _classified(docs.withColumn("row", F.lit(0).cast("long")), labels, sample, most_features).drop("row")


def _classified(docs: DataFrame, labels: DataFrame, sample: int, most_features: int | None) -> DataFrame:
    """classify() with the column row of docs."""
    docs = slim(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("host", F.lit("\0")).alias("host"), F.coalesce("path", F.lit("\0")).alias("path"), F.col("row"), "text")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((1 - F.min("quality")).cast("double").alias("low"), F.max("toxic").cast("double").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of three numbers are broadcast.
    fitted = docs.join(F.broadcast(known), "doc_id").select("doc_id", "low", "toxic", "text").mapInArrow(_encoded, "doc_id long, low double, toxic double, features array<long>")
    fitted = save(fitted.dropDuplicates(["doc_id"]), "labelled")
    # Of the sample only its telling features come to the driver.
    telling = {h: _telling(fitted, h, most_features) for h in HEADS}
    numbers = {f: i for i, f in enumerate(dict.fromkeys(f for h in HEADS for f in telling[h]))}
    chosen = docs.sparkSession.createDataFrame([(f, i) for f, i in numbers.items()], "f long, i int")
    found = fitted.select("doc_id", F.explode("features").alias("f")).join(F.broadcast(chosen), "f").groupBy("doc_id").agg(F.sort_array(F.collect_list("i")).alias("own"))
    # Arrow columns, not rows: the features of the sample are millions of numbers, each of which would be a Python object on the driver.
    rows = fitted.select("doc_id", *HEADS).join(found, "doc_id", "left").toArrow().sort_by("doc_id").combine_chunks()
    own = pc.fill_null(pc.list_value_length(rows["own"]), 0).to_numpy()
    row, col = np.repeat(np.arange(len(own), dtype=np.int32), own), pc.list_flatten(rows["own"]).to_numpy()
    weights = np.stack([_fit(row, col, np.array([telling[h].get(f, 0.0) for f in numbers]), rows[h].to_numpy()) for h in HEADS], axis=1)
    del rows, row, col, found, telling
    pa.default_memory_pool().release_unused()
    scores = save(docs.select("doc_id", "row", "host", "path", "text").mapInArrow(lambda it: _scored(it, numbers, weights), "doc_id long, row long, host string, path string, z_low double, z_toxic double"), "quality")
    sums = [e for h in HEADS for e in (F.sum(_p(F.col(f"z_{h}"))).alias(f"s_{h}"), F.sum(_p(F.col(f"z_{h}")) ** 2).alias(f"q_{h}"))]
    paths = save(scores.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *(f"{k}_{h}" for h in HEADS for k in "sq"))])
    site = paths.select("host", "path", F.col("n").alias("n_path"), *[F.col(f"s_{h}").alias(f"path_{h}") for h in HEADS])
    site = site.join(hosts.select("host", F.col("n").alias("n_host"), *[F.col(f"s_{h}").alias(f"host_{h}") for h in HEADS]), "host")
    out = scores.join(site, ["host", "path"])
    for h in HEADS:
        mu, host_k = _strength(hosts, h)
        _, path_k = _strength(paths, h)
        own = _p(F.col(f"z_{h}"))
        host = (F.col(f"host_{h}") - own + host_k * mu) / (F.col("n_host") - 1 + host_k)
        path = (F.col(f"path_{h}") - own + path_k * host) / (F.col("n_path") - 1 + path_k)
        shift = F.greatest(F.lit(-SITE), F.least(F.lit(SITE), _logit(path) - float(np.log(mu / (1 - mu)))))
        out = out.withColumns({f"site_{h}": path, f"p_{h}": _p(F.col(f"z_{h}") + shift)})
    kept = (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5)
    return out.select("doc_id", "row", *[F.round(_p(F.col(f"z_{h}")), 6).alias(f"doc_{h}") for h in HEADS], *[F.round(f"site_{h}", 6).alias(f"site_{h}") for h in HEADS], *[F.round(f"p_{h}", 6).alias(f"p_{h}") for h in HEADS], kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, most_features: int | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps; of rows that share a doc_id, or have none, those whose text is rejected go.
    Other columns come back as they are, whatever they are called; an empty table gives no rows."""
    own = unused("own", docs)
    row = F.struct("doc_id", F.col(host), F.col(path), F.xxhash64("text"))
    verdict = _classified(docs.select("doc_id", F.xxhash64(row).alias("row"), F.col(host).alias("host"), F.col(path).alias("path"), "text"), labels, sample, most_features)
    gone = verdict.where("not kept").select(F.struct(F.col("doc_id"), F.col("row")).alias(own)).distinct()
    return docs.withColumn(own, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(row).alias("row"))).join(gone, own, "left_anti").drop(own)
