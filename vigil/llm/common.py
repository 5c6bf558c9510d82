"""What the operators share: the shared folder, tables that cut lineage, words."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (as a Java and a DuckDB pattern).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset and the master is local, a temporary
    folder serves; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="llm-shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Bytes of an Arrow batch between the JVM and Python; both sides hold batches of long texts outside their heaps.
BATCH = 8 << 20


def slim(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends batches of BATCH bytes at most to Python."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    size = int(now.rstrip("kmg")) << unit
    if not 0 < size <= BATCH:
        conf.set(key, str(BATCH))
    return df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Where save() has written what it returned.
_saved: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def save(df: DataFrame, name: str, few: bool = False, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here.

    few: df is what shuffles have reduced; it is written by six tasks for each core of the cluster at most, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.coalesce(6 * spark.sparkContext.defaultParallelism)
    # Without Hadoop's native library the driver would start three processes for the mark of success, which only batch schedulers look at.
    df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _saved[out] = path
    _collect(spark)
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables that save() returned.  All that reads them has to be written by then: a lost executor could not read them again."""
    for saved in tables:
        remove(saved.sparkSession, _saved.pop(saved))


def release(spark: SparkSession) -> None:
    """Give back what tables that are written have left: Spark's cleaner removes their shuffles once the driver's collector has found them unused, and the driver's heap shrinks."""
    _collect(spark)
    time.sleep(0.3)  # until then events that have not been handled hold the last query
    _collect(spark)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are collected inside leave no shuffle files once they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_path(uri: str) -> str:
    """The mount point of a shared folder, for files that workers map into memory."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return uri
    raise ValueError(f"memory-mapped files need a shared folder that is mounted on every host, not {uri}")


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder wherever it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(docs: DataFrame) -> DataFrame:
    """docs with one of the rows that share doc_id and text; all rows whose doc_id is null.  Each task drops repeats before rows are shuffled."""
    nth = unused("nth", docs)
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    first = docs.where(F.col("doc_id").isNotNull()).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


def let(value: Column, f) -> Column:
    """f of a value that is computed once per row.  A column that a lambda refers to can be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
