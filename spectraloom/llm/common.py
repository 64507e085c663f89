"""Helpers that several corpus operators share: checkpoints, folds, Arrow byte views, hashing and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that the vectorised kernels handle at once; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
#: Edges of one file of a component round.
EDGES = 1 << 20


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``; a temporary one only where a single process runs everything."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder, of at most ``parts`` files."""
    _folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def stored(df: DataFrame, parts: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a compressed table of at most ``parts`` files in the shared checkpoint folder, and its path for ``discard``."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def pieces_of(table: DataFrame, times: int = 1) -> int:
    """How many tasks suit data of the size of ``table``, a plain table: its splits, and ``times`` the cores at least."""
    return max(times * table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``frames``."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote, and let Spark drop shuffle files that nothing refers to any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold_of(doc_id: Column | str, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the text ``''``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) fixed by the values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, counted: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (all of them if there are no more), chosen by a hash of ``key``; used for fitting only."""
    n = df.count() if counted is None else counted
    return df if n <= rows else df.where(unit_hash(F.col(key), F.lit(seed)) < rows / n)


def byte_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n+1 offsets of its rows; null is empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.fill_null("").cast(pa.large_utf8())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(raw: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last+1, bytes, offsets) of at most ``limit`` bytes, or of one longer row."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer row comes."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12, 0 if have is None else 2 * len(have))
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**position modulo 2**64; ``window_hash`` turns two of them into a substring's hash."""
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(BASE, len(raw)), out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
    back = powers(INVERSE, int(starts.max()) + 1 if len(starts) else 1)
    return mix64((sums[ends] - sums[starts]) * back[starts])


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word ``[^\\x20\\x09-\\x0D]+``, in order, and the n+1 offsets of the rows into them."""
    n = len(offs) - 1
    word = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    at = np.searchsorted(starts, offs)
    row = np.repeat(np.arange(n), np.diff(at))
    return row, window_hash(prefix_sums(raw), starts, ends), at


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src, dst)``: ``(node, component)``, where component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one shuffle with a
    map-side minimum, the number of edges never grows, and a path of length d takes O(log d) rounds.
    Each round is checkpointed, so a lost executor repeats one round at most; the number of its files
    follows the number of edges. Loops and repeated edges are harmless; no edge gives an empty result.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    cur = materialize(_distinct_edges(edges), 4 * cores)
    before, parts = None, 4 * cores
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "src"))
        big = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        low = big.groupBy("src").agg(F.min("dst").alias("low"))
        small = big.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = small.unionByName(low.select("src", F.col("low").alias("dst")))
        cur = materialize(_distinct_edges(small), parts)
        now = tuple(cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before, parts = now, max(cores, -(-now[0] // EDGES))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = cur.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = cur.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end, without loops."""
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
