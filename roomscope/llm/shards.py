"""Sharding by extendible hashing, on DataFrame functions alone (operator 7).

A row's key is 60 bits of the md5 of its id. The directory is indexed by key prefixes: a bucket whose rows exceed the byte limit
splits on its next bit, any other bucket stays whole. Bytes are summed once per fine prefix, so that deciding the splits moves a
row per prefix and not per document, and only prefixes that are still too large are refined further with the documents' keys.

Every shard fits the limit but for a single row that is larger by itself (``oversize``). Rows with equal keys (repeated or null
ids) can't be told apart by their id's bits; where such a bucket is still too large after all 60 bits, it splits on the bits of a
row number's hash instead, until it fits. Null texts count 0 bytes, as empty ones; a text of any length is one row's bytes. An empty
table gives an empty result. Only doc_id and text are read, so other columns' names can't clash. There are no ties: a row's shard
follows from its key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BITS = 60
STEP = 10


def key_bits(col: Column) -> Column:
    """The first 60 bits of the md5 of the value's text, as '0' and '1' characters; null is the text 'null'."""
    hexes = F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), 1, BITS // 4)
    return F.lpad(F.conv(hexes, 16, 2), BITS, "0")


def _leaves(fine: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """From (prefix of ``high`` bits, bytes, n_rows): for each, the shallowest prefix of ``low`` bits or more that fits, or none.

    A node that fits below one that doesn't is a bucket of the directory. Nodes meet their parents, two to one; prefixes meet buckets
    at the few depths that buckets have, so that no key collects the rows of a whole subtree.
    """
    nodes = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("head"))
    nodes = settle(nodes.agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")).withColumn("fits", (F.col("bytes") <= limit) | (F.col("n_rows") == 1)))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("head").alias("above"), F.col("fits").alias("above_fits"))
    children = nodes.where("fits").withColumn("above", F.expr("substring(head, 1, depth - 1)"))
    buckets = settle(children.join(above, ["depth", "above"], "left").where("not coalesce(above_fits, false)").select("head", "bytes", "n_rows", "depth"))
    first, last = buckets.agg(F.min("depth"), F.max("depth")).first()
    if first is None:
        return fine.select("prefix", F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("n_rows"))
    heads = fine.select("prefix", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")).withColumn("head", F.expr("substring(prefix, 1, depth)")).drop("depth")
    best = heads.join(buckets.drop("depth"), "head")
    return fine.select("prefix").join(best, "prefix", "left").select("prefix", "head", "bytes", "n_rows")


def extendible_shards(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, shard (its bit prefix), depth, shard_bytes, oversize."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key_bits(F.col("doc_id")).alias("bits"))
    # One light row per document, kept in the shared folder: later rounds don't read the texts again.
    sized = settle(sized)
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    done, rest, low = [], sized, 0
    high = min(BITS, max(STEP, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    while True:
        fine = rest.groupBy(F.expr(f"substring(bits, 1, {high})").alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
        leaves = settle(_leaves(fine, low, high, limit_bytes))
        found = rest.withColumn("prefix", F.expr(f"substring(bits, 1, {high})")).join(leaves, "prefix", "left")
        done.append(found.where("head is not null").select("doc_id", "n_bytes", F.col("head").alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")))
        if leaves.where("head is null").isEmpty():
            break
        rest = found.where("head is null").select("doc_id", "n_bytes", "bits")
        if high >= len(rest.select("bits").first()[0]):
            # All id bits are used: give the rows of such a key more bits, from the hash of a row number.
            more = F.lpad(F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")), 1, BITS // 4), 16, 2), BITS, "0")
            rest = rest.withColumn("bits", F.concat("bits", more))
        rest = settle(rest)
        low, high = high + 1, high + STEP
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", ((F.col("shard_rows") == 1) & (F.col("shard_bytes") > limit_bytes)).alias("oversize"))


def write_shards(docs: DataFrame, limit_bytes: int, path: str) -> None:
    """Write ``docs`` as Parquet, a folder for each shard. Ids should be unique: rows follow their id's shard."""
    shards = extendible_shards(docs, limit_bytes).select("doc_id", "shard").dropDuplicates(["doc_id"])
    joined = docs.join(shards.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    joined.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def oracle(limit_bytes: int) -> str:
    """The same by definition: of all prefixes of a row's key, the shortest whose rows fit."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS hex FROM documents),
k AS (SELECT doc_id, n_bytes, right(repeat('0', 60) || bin(('0x' || hex)::BIGINT), 60) AS bits FROM d),
p AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth::INTEGER) AS shard FROM k, range(0, 61) r(depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, shard) AS shard_bytes, count(*) OVER (PARTITION BY depth, shard) AS c FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE shard_bytes <= {limit_bytes} OR c = 1)
SELECT doc_id, n_bytes, shard, depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes,
       (c = 1 AND shard_bytes > {limit_bytes}) AS oversize FROM f WHERE k = 1"""
