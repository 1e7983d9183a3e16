"""Pair questions answered in blocks: against brute force, and without the pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roomscope.operators import graph, joins, legacy, pairwise, relations
from roomscope.operators.pairwise import KINDS

POINTS = "scene_id string, ordinal long, uid string, class string, label string, lx double, ly double, lz double, hx double, hy double, hz double, cx double, cy double, cz double"


def points(spark, n, wide, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        c, h = [random.randrange(int(8 * wide)) / 8 for _ in range(3)], [random.randrange(1, 5) / 8 for _ in range(3)]
        rows.append((f"s{i % 2}", i, f"obj_{i}", random.choice(["lamp", "table", "sofa"]), f"x_{i}", *[a - b for a, b in zip(c, h)], *[a + b for a, b in zip(c, h)], *c))
    return spark.createDataFrame(rows, POINTS), rows


def kinds_of(a, b):
    """Types of the edges from a to b, of both directions."""
    if a[0] != b[0] or a[1] == b[1]:
        return set()
    d = [x - y for x, y in zip(a[11:], b[11:])]
    m, far = max(map(abs, d)), math.sqrt(sum(x * x for x in d))
    axis = [abs(x) for x in d].index(m)
    out = {"NEAR"} if far < 1.0 else set()
    if far <= 2.5 and m >= 0.5:
        out.add(KINDS[2 * axis + (d[axis] > 0)])
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pairwise, "SOURCES", 9)
    monkeypatch.setattr(pairwise, "TARGETS", 13)
    monkeypatch.setattr(pairwise, "ROWS", 4)
    monkeypatch.setattr(joins, "LEFT", 7)
    monkeypatch.setattr(joins, "RIGHT", 5)


def test_blocks_equal_brute_force(spark, small):
    e, rows = points(spark, 90, 5)
    want = {(a[0], a[2], b[3], k) for a in rows for b in rows for k in kinds_of(a, b)}
    got = pairwise.kinds(e, e, "class").select("scene_id", "uid", "class", F.explode(pairwise.types(F.col("kinds"))).alias("k")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    stored = {(a, k, b) for a in rows for b in rows for k in kinds_of(a, b) if k in ("LEFT_OF", "BEHIND", "ABOVE") or k == "NEAR" and a[1] < b[1]}
    n = {s: sum(a[0] == s for a, _, _ in stored) for s in ("s0", "s1")}
    assert {r.scene_id: r.n0 + r.directed for r in pairwise.counts(e, [1.0], 2.5).collect()} == n
    for most in (1, 8):
        text = {a[2]: "; ".join(f"{k} {b[4]}" for k, _, b in sorted((k, b[1], b) for x, k, b in stored if x is a)[:most]) for a in rows}
        assert {r.uid: r.relations for r in graph.compact_context(pairwise.first_relations(e, most), e, most).collect()} == text
    edges = relations.directional_sparse(e, carry=("class",)).unionByName(relations.near_sparse(e, carry=("class",))).collect()
    assert len(edges) == len(stored) and {(r.src_uid, r.type, r.tgt_uid, r.src_class, r.tgt_class) for r in edges} == {(a[2], k, b[2], a[3], b[3]) for a, k, b in stored}
    lamps = e.where("class = 'lamp' and ordinal < 20")
    hops, last = {a[2]: 0 for a in rows if a[3] == "lamp" and a[1] < 20}, None
    for k in (1, 2):
        last = {a[2] for a in rows if a[2] not in hops and any(hops.get(b[2]) == k - 1 and kinds_of(a, b) for b in rows)}
        hops |= dict.fromkeys(last, k)
    assert {r.uid: r.hops for r in pairwise.reached(e, lamps, 2).collect()} == hops


def test_all_directions_equal_the_pairs(spark, small):
    e, _ = points(spark, 60, 3)
    pairs = relations.directional_compat(e).groupBy("scene_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat("src_uid", "tgt_uid")).alias("least"), F.max(F.concat("src_uid", "tgt_uid")).alias("greatest"))
    assert sorted(map(tuple, pairwise.all_directions(e).collect())) == sorted(map(tuple, pairs.collect()))


def test_legacy_scores_equal_those_of_edges(spark):
    e, _ = points(spark, 60, 4)
    q = legacy.parse(spark.createDataFrame([("a", "What is left of the table?"), ("b", "what is near the sofa"), ("c", "what is above the lamp")], "question_id string, text string"), ["table", "lamp", "sofa"])
    stored = relations.directional_sparse(e).unionByName(relations.near_sparse(e))
    flat = lambda df: sorted((r.question_id, r.uid, round(r.score, 9)) for r in df.collect())
    assert flat(legacy.score(q, e)) == flat(legacy.score(q, e, graph.canonical(stored)))


def shuffled(spark, df):
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: store.executorSummary("driver").totalShuffleWrite()
    began = total()
    df.collect()
    return total() - began


def test_no_pairs_are_shuffled(spark):
    """A crowded scene has 280,000 pairs of 1,500 entities; none of them is shuffled for what is asked of them."""
    e, _ = points(spark, 1500, 2)
    e = e.persist()
    e.count()
    for df in (pairwise.kinds(e, e, "class"), pairwise.first_relations(e, 8), pairwise.counts(e, [1.0], 2.5), relations.directional_sparse(e, carry=("class",)).where("src_class = 'lamp'").agg(F.count("src_uid"))):
        assert shuffled(spark, df) < 4_000_000
    e.unpersist()


def test_rests_equal_all_pairs(spark, small):
    e, _ = points(spark, 120, 3)
    near = joins.near_boxes(e, 0.05, "nested", ordered=False).where("a.class = 'lamp' and b.class in ('table', 'sofa')").where("a.lz - b.hz between -0.03 and 0.02 and a.cz >= b.hz and a.lx <= b.hx and b.lx <= a.hx and a.ly <= b.hy and b.ly <= a.hy")
    want = {(r[0], r[1]) for r in near.select("a.uid", "b.uid").collect()}
    assert {(r.src_uid, r.tgt_uid) for r in relations.on_entity_surface(e).collect()} == want and want
