"""Masks, meshes and components in parts that follow the input."""

import random

import pytest
from pyspark.sql import functions as F

from roomscope.operators import masks, pairwise, relations
from tests.test_pairwise import points, shuffled


@pytest.fixture
def mv(spark):
    random.seed(4)
    rows = {("s", random.randrange(30), random.randrange(60)) for _ in range(500)}
    return spark.createDataFrame(sorted(rows), "scene_id string, mask_id long, vertex_id long")


def test_parts_follow_the_input(spark, mv):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert masks.parts_for(mv, 10) == few and masks.parts_for(mv, 300_000 * 50 + 1) == 51


def test_intersections_are_dealt_in_more_parts(spark, mv, monkeypatch):
    monkeypatch.setattr(masks, "parts_for", lambda df, rows: max(1, rows // 10))
    own = {}
    for r in mv.collect():
        own.setdefault(r.mask_id, set()).add(r.vertex_id)
    want = {(a, b, len(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b]}
    got = masks.mask_intersections(mv)
    assert {(r.a, r.b, r.shared) for r in got.collect()} == want and got.rdd.getNumPartitions() == mv.count() // 10
    faces = mv.select(F.col("mask_id").alias("face"), F.col("vertex_id").alias("v"))
    pairs = masks.vertex_pairs(faces.unionByName(faces)).collect()  # a corner met twice is one
    assert sorted(map(tuple, pairs)) == sorted((f, a, b) for f, vs in own.items() for a in vs for b in vs if a < b)


def test_union_curve_gathers_only_candidates(spark):
    """200 masks of 300 vertices meet both instances; the vertices of one of them are gathered."""
    mv = spark.range(200).crossJoin(spark.range(300).toDF("v")).select(F.lit("s").alias("scene_id"), F.col("id").alias("mask_id"), F.expr("(id * 7 + v * 3) % 1000").alias("vertex_id"))
    oracle = spark.range(1000).select(F.lit("s").alias("scene_id"), F.col("id").alias("vertex_id"), (F.col("id") % 2).alias("instance_id"))
    got = masks.union_curve(mv, oracle, most=2, candidates=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_set") < plan.index("row_number")  # the rank lies below the gathering
    own = {r.mask_id: {x.vertex_id for x in mv.where(f"mask_id = {r.mask_id}").collect()} for r in got.collect()}
    for r in got.collect():
        inside = {v for v in own[r.mask_id] if v % 2 == r.instance_id}
        assert r.step == 1 and r.iou == pytest.approx(len(inside) / (len(own[r.mask_id]) + 500 - len(inside)))


def test_links_connect_what_near_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "SOURCES", 9)
    monkeypatch.setattr(pairwise, "TARGETS", 13)
    node = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    joined = lambda df: sorted(map(tuple, masks.min_labels(df.select(node("src_uid").alias("a"), node("tgt_uid").alias("b"))).select("node", "component").collect()))
    e, _ = points(spark, 120, 4)
    links = pairwise.near_links(e, 0.6)
    assert joined(links) == joined(relations.near_sparse(e, 0.6))


def test_links_of_a_crowd_are_few(spark):
    e, _ = points(spark, 1200, 1)
    links = pairwise.near_links(e, 0.6)
    assert links.count() < 30 * 1200 < relations.near_sparse(e, 0.6).count()
    assert shuffled(spark, links) < 3_000_000
