"""Helpers shared by the operators: scratch tables, size-checked broadcasts, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slim (at most 40 bytes a row) table that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000

SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset (tests) a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir().rstrip("/") + "/feedloom-scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the scratch root, removed when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/feedloom-{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the scratch folder and read it back: lineage is cut, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors' Python workers, once per application."""
    import os
    import shutil

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="feedloom-code-")  # of the driver; Spark serves the file to the executors
    root = os.path.join(folder, "root")
    shutil.copytree(package, os.path.join(root, os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "feedloom_code"), "zip", root))
    _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Returns the memory that this process has freed to the system; its allocators would keep it for later."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        pass


def arrow_map(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema) with this package at hand in the workers, which outlive their tasks but don't keep the memory."""

    def tidy(batches):
        yield from work(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted), else df unchanged for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-made table as a literal of the plan: no RDD, no Python on executors."""
    import json

    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


# -- word hashing in numpy ----------------------------------------------------------------------

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of words: white space, or all ASCII but letters and digits.
_PUNCT = np.ones(256, bool)
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK + 1), U(b))
            p[0] = U(1)
            _POWERS[i] = np.cumprod(p, dtype=U)
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_words(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data (bytes) and their start offsets; no word crosses one of bounds."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~apart[data]
    cut_at = np.zeros(n + 1, bool)
    cut_at[bounds[bounds <= n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | cut_at[:n]))
    ends = np.flatnonzero(word & (after | cut_at[1:])) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[_FOLD[data]] * power, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(U)), starts


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; a null is an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def doc_words(data: np.ndarray, offsets: np.ndarray, letters: bool = False):
    """Yield (first, word hashes, pointers) for runs of documents of about CHUNK bytes.

    Words end at white space or, with letters, at any ASCII character but letters and digits.
    Document first+i has the words hashes[pointers[i]:pointers[i+1]]. A text longer than CHUNK is hashed
    in pieces cut between words, so the working memory beside the hashes stays bounded.
    """
    apart = _PUNCT if letters else _SPACE
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1, i + 1)
        j = min(j, n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * CHUNK:
            h, starts = _hash_words(data[lo:hi], offsets[i : j + 1] - lo, apart)
            yield i, h, np.searchsorted(starts, offsets[i : j + 1] - lo)
        else:
            parts, at = [], lo
            while at < hi:
                end = min(at + CHUNK, hi)
                while end < hi and not apart[data[end]]:
                    more = np.flatnonzero(apart[data[end : end + CHUNK]])
                    end = min(end + (int(more[0]) if len(more) else CHUNK), hi)
                parts.append(_hash_words(data[at:end], np.zeros(1, np.int64), apart)[0])
                at = end
            h = np.concatenate(parts)
            yield i, h, np.array([0, len(h)])
        i = j


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle; none, none."""
    if len(h) == 0:
        return h
    if len(h) < k:
        out = np.array([len(h)], U)
        for x in h:
            out = mix64(out * np.array([0x9E3779B97F4A7C15], U) + x)
        return out
    m = len(h) - k + 1
    out = np.full(m, U(k))
    for i in range(k):
        out *= U(0x9E3779B97F4A7C15)
        out += h[i : i + m]
    out = mix64(out)
    out.sort()
    keep = np.empty(m, bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


# -- connected components -----------------------------------------------------------------------


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Alternating large-star and small-star steps; minima are pre-aggregated, and each step's edges are cut
    to the scratch folder. Nodes without an edge don't appear. Edges are compared by count and hash sum to stop.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut(e, name)
    mark = None
    for _ in range(50):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    leaf = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
