"""Scene tables as deterministic projections of the test tables (see FIXTURES.md, part 4).

Coordinates lie on a lattice of exact binary fractions, so that two engines compute equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("table", "desk", "chair", "stool", "bench", "shelf", "sofa", "plant-stand", "counter", "lamp")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(k: int) -> Column:
    return F.col("embedding")[k].cast("double")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, ordinal, uid, class, label, box lo/hi and centroid as nine columns."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    base = load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("scene_"), (F.col("vec_id") % 4).cast("string")).alias("scene_id"),
        F.col("vec_id").cast("long").alias("ordinal"),
        F.concat(F.lit("obj_"), F.col("vec_id").cast("string")).alias("uid"),
        names[F.col("label")].alias("class"),
        (F.floor(_d(0) * 128) / 8).alias("cx"), (F.floor(_d(1) * 128) / 8).alias("cy"), (F.floor(_d(2) * 32) / 8 + 1).alias("lz"),
        ((F.floor(F.abs(_d(3)) * 16) + 1) / 8).alias("ex"), ((F.floor(F.abs(_d(4)) * 16) + 1) / 8).alias("ey"), ((F.floor(F.abs(_d(5)) * 8) + 1) / 4).alias("h"),
    )
    return base.select(
        "scene_id", "ordinal", "uid", "class", F.concat_ws("_", "class", F.expr("ordinal")).alias("label"),
        (F.col("cx") - F.col("ex")).alias("lx"), (F.col("cy") - F.col("ey")).alias("ly"), "lz",
        (F.col("cx") + F.col("ex")).alias("hx"), (F.col("cy") + F.col("ey")).alias("hy"), (F.col("lz") + F.col("h")).alias("hz"),
        "cx", "cy", (F.col("lz") + F.col("h") / 2).alias("cz"),
    )


def surfaces(ents: DataFrame) -> DataFrame:
    """Six surfaces of each scene: plane a, b, c, d and the bounds of its rectangular polygon."""
    room = ents.groupBy("scene_id").agg(*[F.min(c).alias(c) for c in ("lx", "ly", "lz")], *[F.max(c).alias(c) for c in ("hx", "hy", "hz")])
    rows = [
        (0, "floor", "floor", 0, 0, 1, "-lz", "lx", "ly", "lz", "hx", "hy", "lz"), (1, "ceiling", "ceiling", 0, 0, -1, "hz", "lx", "ly", "hz", "hx", "hy", "hz"),
        (2, "wall_w", "wall", 1, 0, 0, "-lx", "lx", "ly", "lz", "lx", "hy", "hz"), (3, "wall_e", "wall", -1, 0, 0, "hx", "hx", "ly", "lz", "hx", "hy", "hz"),
        (4, "wall_s", "wall", 0, 1, 0, "-ly", "lx", "ly", "lz", "hx", "ly", "hz"), (5, "wall_n", "wall", 0, -1, 0, "hy", "lx", "hy", "lz", "hx", "hy", "hz"),
    ]
    each = F.array(*[
        F.struct(F.lit(o).alias("ordinal"), F.lit(u).alias("suid"), F.lit(t).alias("stype"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c"), F.expr(d).alias("d"),
                 *[F.expr(e).alias(n) for e, n in zip(p, ("plx", "ply", "plz", "phx", "phy", "phz"), strict=True)])
        for o, u, t, a, b, c, d, *p in rows
    ])
    return room.select("scene_id", F.explode(each).alias("s")).select("scene_id", "s.*")


#: The same projections for the second engine.
ENTITY_SQL = """
entity AS (SELECT scene_id, ordinal, uid, class, class || '_' || ordinal AS label, cx - ex AS lx, cy - ey AS ly, lz, cx + ex AS hx, cy + ey AS hy, lz + h AS hz, cx, cy, lz + h / 2 AS cz FROM (
  SELECT 'scene_' || (vec_id % 4) AS scene_id, vec_id::BIGINT AS ordinal, 'obj_' || vec_id AS uid,
    ['table','desk','chair','stool','bench','shelf','sofa','plant-stand','counter','lamp'][label + 1] AS class,
    floor(embedding[1]::DOUBLE * 128) / 8 AS cx, floor(embedding[2]::DOUBLE * 128) / 8 AS cy, floor(embedding[3]::DOUBLE * 32) / 8 + 1 AS lz,
    (floor(abs(embedding[4]::DOUBLE) * 16) + 1) / 8 AS ex, (floor(abs(embedding[5]::DOUBLE) * 16) + 1) / 8 AS ey, (floor(abs(embedding[6]::DOUBLE) * 8) + 1) / 4 AS h FROM embeddings))"""
SURFACE_SQL = """
room AS (SELECT scene_id, min(lx) lx, min(ly) ly, min(lz) lz, max(hx) hx, max(hy) hy, max(hz) hz FROM entity GROUP BY scene_id),
surface AS (
  SELECT scene_id, 0 AS ordinal, 'floor' AS suid, 'floor' AS stype, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, -lz AS d, lx AS plx, ly AS ply, lz AS plz, hx AS phx, hy AS phy, lz AS phz FROM room
  UNION ALL SELECT scene_id, 1, 'ceiling', 'ceiling', 0, 0, -1, hz, lx, ly, hz, hx, hy, hz FROM room
  UNION ALL SELECT scene_id, 2, 'wall_w', 'wall', 1, 0, 0, -lx, lx, ly, lz, lx, hy, hz FROM room
  UNION ALL SELECT scene_id, 3, 'wall_e', 'wall', -1, 0, 0, hx, hx, ly, lz, hx, hy, hz FROM room
  UNION ALL SELECT scene_id, 4, 'wall_s', 'wall', 0, 1, 0, -ly, lx, ly, lz, hx, ly, hz FROM room
  UNION ALL SELECT scene_id, 5, 'wall_n', 'wall', 0, -1, 0, hy, lx, hy, lz, hx, hy, hz FROM room)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, mask_id, score."""
    s = load(spark, sf_dir, "supplier")
    span = s.agg(F.min("s_acctbal").cast("double").alias("lo"), F.max("s_acctbal").cast("double").alias("hi"))
    # One row of two numbers.
    return s.crossJoin(F.broadcast(span)).select(F.lit("scene_0").alias("scene_id"), F.col("s_suppkey").cast("long").alias("mask_id"), ((F.col("s_acctbal").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


def mask_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, mask_id, vertex_id."""
    return load(spark, sf_dir, "lineitem").select(F.lit("scene_0").alias("scene_id"), F.col("l_suppkey").cast("long").alias("mask_id"), F.col("l_partkey").cast("long").alias("vertex_id")).distinct()


def oracle_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, vertex_id, instance_id of the reference labelling."""
    return load(spark, sf_dir, "part").select(F.lit("scene_0").alias("scene_id"), F.col("p_partkey").cast("long").alias("vertex_id"), F.col("p_size").cast("long").alias("instance_id"))


MASK_SQL = """
mask AS (SELECT 'scene_0' AS scene_id, s_suppkey::BIGINT AS mask_id, (s_acctbal::DOUBLE - min(s_acctbal::DOUBLE) OVER ()) / (max(s_acctbal::DOUBLE) OVER () - min(s_acctbal::DOUBLE) OVER ()) AS score FROM supplier),
mv AS (SELECT DISTINCT 'scene_0' AS scene_id, l_suppkey::BIGINT AS mask_id, l_partkey::BIGINT AS vertex_id FROM lineitem),
ov AS (SELECT 'scene_0' AS scene_id, p_partkey::BIGINT AS vertex_id, p_size::BIGINT AS instance_id FROM part)"""
