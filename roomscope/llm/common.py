"""Pieces shared by the operators: table access, hashing, packed blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[0x20, 9, 10, 11, 12, 13]] = True
U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo ``mod``; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only in local mode, where there is one machine, and none is set (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roomscope-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate (file sizes for a scan); no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


MOST_SMALL_SHARDS = 4096
SHARD_BYTES = 256 << 20


def partition_bytes(df: DataFrame) -> int | None:
    """About what a partition holds, by Catalyst's estimate; None where there is none (no files below, or a join's guess)."""
    size = input_bytes(df) // max(1, df.rdd.getNumPartitions())
    return size if size <= 1 << 30 else None


def shard_count(df: DataFrame, per_shard: int = 8 << 20, least: int = 8, spread: int = 64) -> int:
    """Shards that keep one shard's packed arrays small, and few enough for a block to have something to say to each.

    As many as there are shuffle partitions, but for that reason alone not more than ``spread``. Up to 4096 shards of 8 MB; beyond them
    shards grow to 256 MB before their number does. Where the size isn't known, a partition is taken to hold 64 MB.
    """
    size = (partition_bytes(df) or 64 << 20) * df.rdd.getNumPartitions()
    wanted = max(min(math.ceil(size / per_shard), MOST_SMALL_SHARDS), math.ceil(size / SHARD_BYTES))
    return max(least, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread), wanted)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text each (one longer text is a block of its own)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        lens = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for i, n in enumerate(lens.tolist()):
            if held and held + n > most:
                part = batch.slice(start, i - start)
                yield part, texts_as_bytes(part.column(part.schema.get_field_index(text)))
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, texts_as_bytes(part.column(part.schema.get_field_index(text)))


def release() -> None:
    """Give a task's freed memory back to the system: Python workers live on from task to task."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _GOLD) | U(1)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(m, dtype=np.uint64)
            done = 1
            while done < m:
                step = pow(base, done, 1 << 64)
                p[done : 2 * done] = p[:done] * U(step)
                done *= 2
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes], split: np.ndarray = _SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the (already lower-cased) texts in order, and how many words each text has.

    One pass over a joined buffer: prefix sums of byte codes times powers of an odd base; no word becomes a Python object.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    n = len(buf)
    power, inverse = _powers(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * power[:n], out=sums[1:])
    gap = np.flatnonzero(split[buf])
    start = np.empty(len(gap), dtype=np.int64)
    start[0] = 0
    start[1:] = gap[:-1] + 1
    keep = gap > start
    start, end = start[keep], gap[keep]
    h = mix((sums[end] - sums[start]) * inverse[start])
    bounds = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, bounds))))
    return h, counts
