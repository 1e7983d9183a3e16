"""Exact top-k search by inner product, in a columnar branch-and-bound (operator 3).

A vector becomes the integers floor(64 * x). Candidates are dealt evenly into lanes, once, and kept in the shared folder. Queries go
to all lanes in groups of at most about GROUP rows, each one a broadcast of that bounded size, and a lane streams its candidates in
blocks held vertically (dimension by dimension). The partial sums of a chunk of queries grow one block of dimensions after another;
after each, the candidates whose partial sum plus the largest possible rest (by Cauchy-Schwarz on the remaining mass) falls below the
k-th best score so far of every query of the chunk are compacted away. What is left has its exact score.

A task holds one group of queries and one block of candidates; nothing is copied per group but the queries. The lanes' best k are
merged by a window per query row, whose input is at most k rows for each lane.

Vectors that are null, empty or hold a null, NaN or infinite component take no part. Shorter vectors count as filled up with
zeros. A query's own row is no candidate, other rows with its vec_id are; rows without an id are candidates, last among ties, and
never queries. Repeated query rows are answered once for each row. Scores beyond 64 bits are held to the nearest 64-bit value. An
empty table gives an empty result; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_folder

DIMS = 16
BLOCK = 2048
GROUP = 8192
CHUNK = 256
SCHEMA = "query_row long, query_id long, vec_id long, score long"


def _digits(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """floor(64 x) of a batch as float64 rows, exact integers."""
    lists = batch.column(batch.schema.get_field_index("embedding"))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), width))
    row = np.repeat(np.arange(len(lens)), lens)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row, col] = np.floor(flat * 64.0)
    return out


class Best:
    """The k best (score, then smaller id, null last) of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0)
        self.ids = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        self.floor = -math.inf

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate((self.score, score)), np.concatenate((self.ids, ids)), np.concatenate((self.null, null))
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], null[i], ids[i]))[: self.k], dtype=np.int64)
        else:
            order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.floor = self.score[-1]


class Queries:
    """A group of queries: rows, ids, digits (queries by dimensions), norms of what is left from each step on."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, digits: np.ndarray, dims: int):
        self.rows, self.ids, self.digits = rows, ids, digits
        self.rests = _rests(digits.T, dims)


class Candidates:
    """A vertical block (dimensions by candidates), the longest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, null: np.ndarray, digits: np.ndarray, dims: int):
        order = np.argsort(-np.square(digits).sum(axis=1), kind="stable")
        self.rows, self.ids, self.null = rows[order], ids[order], null[order]
        self.x = np.ascontiguousarray(digits[order].T)
        self.rests = _rests(self.x, dims)


def search_block(q: Queries, at: slice, c: Candidates, best: list[Best], dims: int) -> None:
    """A chunk of queries against one block."""
    mine, rest = q.digits[at], q.rests[:, at]
    floor = np.array([b.floor for b in best[at]])
    # A hair above the rounding of the norms, so that no candidate on the bound is lost.
    reach = lambda step, live: rest[step][:, None] * (c.rests[step][live] * (1 + 1e-9))[None, :] + 1e-6
    live = np.flatnonzero((reach(0, slice(None)) >= floor[:, None]).any(axis=0))
    part = np.zeros((len(mine), len(live)))
    keep = np.ones(part.shape, dtype=bool)
    for step, a in enumerate(range(0, mine.shape[1], dims)):
        if not len(live):
            return
        part += mine[:, a : a + dims] @ c.x[a : a + dims, live]
        keep = part + reach(step + 1, live) >= floor[:, None]
        some = keep.any(axis=0)
        if some.sum() < 0.9 * len(live):
            live, part, keep = live[some], part[:, some], keep[:, some]
    rows, ids, null = c.rows[live], c.ids[live], c.null[live]
    for i in np.flatnonzero(keep.any(axis=1)).tolist():
        j = np.flatnonzero(keep[i] & (rows != q.rows[at][i]))
        best[at.start + i].add(part[i, j], ids[j], null[j])


def _exactly(q: Queries, c: Candidates, best: list[Best]) -> None:
    """The same where doubles would round: whole numbers of any size."""
    big = [[int(v) for v in col] for col in c.x.T]
    for row, digits, hold in zip(q.rows, q.digits, best, strict=True):
        hold.score = hold.score.astype(object)
        w = [int(v) for v in digits]
        live = np.flatnonzero(c.rows != row)
        hold.add(np.array([sum(p * x for p, x in zip(w, big[j], strict=True)) for j in live], dtype=object), c.ids[live], c.null[live])


def _rests(x: np.ndarray, dims: int) -> np.ndarray:
    """Norms of the components from each step's start to the end; x: dimensions by vectors."""
    steps = -(-x.shape[0] // dims)
    out = np.zeros((steps + 1, x.shape[1]))
    for s in range(steps - 1, -1, -1):
        out[s] = out[s + 1] + np.square(x[s * dims : (s + 1) * dims]).sum(axis=0)
    return np.sqrt(out)


def _search(asked, k: int, width: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors = asked.value
        q = Queries(rows, ids, vectors.astype(np.float64), dims)
        best = [Best(k) for _ in rows]
        longest = float(q.rests[0].max(initial=0.0))
        for batch in batches:
            for b in range(0, batch.num_rows, BLOCK):
                block = batch.slice(b, BLOCK)
                c = Candidates(
                    block.column(0).to_numpy(), block.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                    block.column(1).is_null().to_numpy(zero_copy_only=False), _digits(block, width), dims,
                )
                if float(c.rests[0].max(initial=0.0)) * longest >= 2.0**53:
                    _exactly(q, c, best)
                    continue
                for at in range(0, len(rows), CHUNK):
                    search_block(q, slice(at, min(at + CHUNK, len(rows))), c, best, dims)
        sizes = [len(b.ids) for b in best]
        if not sum(sizes):
            return
        score = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for b in best for x in b.score]
        vec = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.null for b in best]))
        out = pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(ids, sizes)), vec, pa.array(score, pa.int64())], names=["query_row", "query_id", "vec_id", "score"])
        for at in range(0, out.num_rows, 50_000):
            yield out.slice(at, 50_000)

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, lanes: int | None = None, group: int = GROUP, dims: int = DIMS) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    sound = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    is_query = F.col("vec_id") % every == 0
    n = sound.count()
    lanes = lanes or max(8, min(2 * spark.sparkContext.defaultParallelism, -(-n // 512)))
    dealt = settle(sound.repartition(lanes))  # in turn: lanes differ by a row or so for each partition read
    width, n_asked = (x or 0 for x in dealt.agg(F.max(F.size("embedding")), F.count(F.when(is_query, 1))).first())
    groups = max(1, math.ceil(n_asked / group))
    folder = f"{shared_folder(spark)}/roomscope_topk_{uuid.uuid4().hex}"
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    for g in range(groups):
        rows = dealt.where(is_query & (F.pmod(F.xxhash64("row"), F.lit(groups)) == g)).toArrow()
        digits = np.concatenate([_digits(x, width) for x in rows.to_batches()]) if rows.num_rows else np.zeros((0, width))
        small = digits.astype(np.int16) if np.abs(digits).max(initial=0) < 1 << 15 else digits
        # One group of queries: 8192 of them, give or take the hash's chance, are 1 MB at 64 dimensions.
        asked = spark.sparkContext.broadcast((rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), small))
        found = dealt.mapInArrow(_search(asked, k, width, dims), SCHEMA).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if groups == 1:
            return found
        found.write.mode("append").parquet(folder)
        asked.unpersist()
    return spark.read.parquet(folder)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
