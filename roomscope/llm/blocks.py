"""A table of text blocks, and packed exchanges between blocks and hash shards.

Operators that compare every text with every other one send short fingerprints to hash shards and want the shards' answers back
where the text is. The texts are therefore written once, without a shuffle, as a table bucketed by block; a later co-group with
answers then moves only the answers. Fingerprints travel as one packed binary row for each block and shard that it has something
for, so that neither the JVM nor Python handles them one by one.

A block is a part of a partition, its rows dealt in turn so that it holds about BLOCK_BYTES of text. A shard is 8 MB of text up to
MOST_SMALL_SHARDS shards and grows with the input up to SHARD_BYTES beyond them, so that a block of 64 MB sends each shard 160 bytes
or more even at 100 TB: the rows' own overhead stays below what they carry.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_bytes, release, shard_count, shared_folder

PACKED = "shard int, block int, payload binary"
#: Buckets of the table; beyond it several blocks share a bucket, but never a group.
_MOST_BUCKETS = 50_000
BLOCK_BYTES = 64 << 20
#: Text in a byte of Parquet, at most, as far as the size of blocks is concerned.
_EXPANSION = 4


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)))
        parts.append(a.tobytes())
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sI", data, at)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(data, dtype=dtype, count=size, offset=at + 6))
        at += 6 + size * dtype.itemsize
    return out


def join_packed(payloads: Iterable[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Column-wise concatenation of payloads of one layout, and the length of the first column of each."""
    parts = [unpack(p) for p in payloads]
    if not parts:
        return [], np.zeros(0, dtype=np.int64)
    return [np.concatenate(cols) for cols in zip(*parts, strict=True)], np.array([len(p[0]) for p in parts])


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block, pa.int32()), pa.array(payload, pa.binary())], names=["shard", "block", "payload"])


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the upper half of a hash; the lower half stays independent of it."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' rows of each shard that has any, in their order."""
    order = np.argsort(shard, kind="stable")
    told = shard[order]
    edges = np.flatnonzero(np.concatenate(([True], told[1:] != told[:-1], [True]))) if len(told) else np.zeros(1, dtype=np.int64)
    columns = [c[order] for c in columns]
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(told[a]), [c[a:z] for c in columns]


class Blocks:
    """Texts in a bucketed table of the shared folder: block, row (unique in its block), doc_id, text (binary), and more columns.

    Further columns are stored as more_0, more_1 and so on, so that no name of theirs can clash. Used as a context: the table goes
    at the end, whatever happens; results read from it must have been settled by then.
    """

    def __init__(self, docs: DataFrame, *more: str, shards: int | None = None):
        spark = self.spark = docs.sparkSession
        self.more = [f"more_{i}" for i in range(len(more))]
        self.shards = shards or shard_count(docs)
        partitions = docs.rdd.getNumPartitions()
        parts = max(1, math.ceil((partition_bytes(docs) or 0) * _EXPANSION / BLOCK_BYTES))
        self.count = max(1, partitions * parts)
        n = min(_MOST_BUCKETS, self.count)
        number = F.monotonically_increasing_id()
        place = F.spark_partition_id() * F.lit(parts) + F.pmod(number.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(parts)).cast("int")
        texts = docs.select(
            place.alias("place"), number.alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
            F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("text"), *(docs[f"`{c}`"].alias(k) for c, k in zip(more, self.more, strict=True)),
        )
        if self.count <= n:
            # A label for each bucket, the smallest number whose hash falls into it: at most 50,000 small rows are broadcast.
            labels = spark.range(0, 64 * n + 1024).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("place")).groupBy("place").agg(F.min("id").alias("id")).collect()
            label = dict.fromkeys(range(n), 0) | {r.place: r.id for r in labels}
            named = spark.createDataFrame([(p, int(k)) for p, k in sorted(label.items())], "place int, block int")
            texts = texts.join(F.broadcast(named), "place").drop("place")
        else:
            texts = texts.withColumnRenamed("place", "block")
        self.name = f"roomscope_blocks_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        try:
            texts.write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(n, "block").saveAsTable(self.name)
        except BaseException:
            self.drop()
            raise
        self.table = spark.table(self.name)

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def emit(self, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from fn(batches)
            release()

        return self.table.select("block", "row", "doc_id", "text").mapInArrow(run, PACKED)

    def emit_whole(self, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """As emit(), but fn gets a whole block, as with_answers() does; no shuffle, the table is bucketed by block."""
        return self.table.groupBy("block").applyInArrow(fn, PACKED)

    def answer(self, sent: DataFrame, fn: Callable[[list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
        """Each shard sees its (block, payload) rows and returns (block, payload) answers."""

        def run(group: pa.Table) -> pa.Table:
            shard = group.column("shard")[0].as_py()
            rows = sorted(zip(group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True))
            del group
            out = pa.Table.from_batches([packed_batch([(shard, b, p) for b, p in fn(rows)])])
            del rows
            release()
            return out

        return sent.groupBy("shard").applyInArrow(run, PACKED)

    def with_answers(self, answers: DataFrame, fn: Callable[[pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
        """fn of each block's rows and the (shard, payload) answers sent to it, in shard order."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = fn(left, sorted(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist(), strict=True)))
            release()
            return out

        return self.table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
