"""What the operators share: tables, scratch space, lookups by a skewed key, words and hashes."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows is looked up by broadcast: at most 1 / HOT_SHARE keys.
HOT_SHARE = 1 / 1000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))


def numbered(docs: DataFrame, columns: list[str] | None = None, bucketed: bool = False) -> tuple[DataFrame, str]:
    """docs (columns of it, if given) with a number for each row, saved, and the name of that column, which no column of
    docs has. Rows may share a doc_id, or have none: what is decided by row is decided for that row alone.

    bucketed: the rows move once, to buckets by their number, and stay there in every later join on it."""
    names = {c.lower() for c in docs.columns}
    row = next(n for n in (f"row{'_' * i}" for i in range(len(names) + 1)) if n not in names)
    rows = docs.select(F.monotonically_increasing_id().alias(row), *(columns or docs.columns))
    if not bucketed:
        return saved(rows, "rows"), row
    spark, name = docs.sparkSession, f"rows_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(n, row).write.bucketBy(n, row).format("parquet").option("compression", "zstd")
    out.option("path", scratch(spark, "rows")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # out of the catalogue; the files stay, and so does what was made of them
    return table, row


def row_texts(rows: DataFrame, row: str) -> DataFrame:
    """row, doc_id and text alone (null text: empty) of what numbered() returned."""
    return rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rows["text"], F.lit("")).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^]]*\])?$", spark.conf.get("spark.master", "local")):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{_own_folder()}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


#: Paths handed out while settled() waits for its frame.
_SCOPES: list[list[str]] = []


@cache
def _own_folder() -> str:
    """Scratch space of a local session; it goes with this process."""
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared scratch folder and read again: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), saved; whatever else was written to the scratch folder meanwhile goes, as nothing reads it any more."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        out = saved(make(), name)
    finally:
        _SCOPES[:] = [x for x in _SCOPES if x is not made]
    _delete(spark, made[:-1])  # the last is out's
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that saved() returned and that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, paths) -> None:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def looked_up(left: DataFrame, right: DataFrame, key: str | list[str], size: str, rows: int) -> DataFrame:
    """left, with the columns of right by an equal key (inner); right has one row a key, and size holds the
    key's rows in left (or an upper bound of them that sums to rows at most). Keys with over HOT_SHARE of the
    rows, 1 / HOT_SHARE at most, are broadcast; the others meet in a sort-merge join without a hot key."""
    bound = max(1000, int(rows * HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(size) > bound))
    keys = [key] if isinstance(key, str) else key
    rest = left.join(F.broadcast(right.filter(F.col(size) > bound).select(*keys)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.filter(F.col(size) <= bound).hint("merge"), key))


def sliced(batch: pa.RecordBatch, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, in order, in slices of about size bytes of text (one row at least)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each k consecutive items."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    out, n, odd = np.zeros(len(hashes) - k + 1, np.uint64), len(hashes) - k + 1, np.uint64(seed | 1)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * odd + hashes[j : j + n]
        return mixed(out)
