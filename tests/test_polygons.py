import random

import numpy as np
from pyspark.sql import functions as F

from roomscope.functions import polygon as poly
from roomscope.operators import correspond

SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_inside_and_hull():
    random.seed(1)
    ell = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]
    assert poly.inside((0.5, 2.5), ell) and not poly.inside((2, 2), ell) and poly.inside((1, 1), ell) and poly.inside((2, 1), ell)
    pts = np.array([(random.random(), random.random()) for _ in range(60)])
    h = poly.hull(pts)
    assert all(poly.inside(p, h) for p in pts)
    assert np.allclose(sorted(map(tuple, poly.hull(pts[::-1]))), sorted(map(tuple, h)))
    assert len(poly.hull(np.array([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]))) == 4


def test_gaps():
    assert poly.polygon_gap(SQUARE, [(1, 1), (5, 1), (5, 5)]) == 0
    assert poly.polygon_gap(SQUARE, [(0.5, 0.5), (1, 0.5), (1, 1)]) == 0
    assert poly.polygon_gap(SQUARE, [(3, 0), (4, 0), (4, 2)]) == 1
    assert abs(poly.polygon_gap(SQUARE, [(3, 3), (4, 3), (4, 4)]) - 2**0.5) < 1e-12
    cross = poly.polygon_gap([(-1, 0.9), (3, 0.9), (3, 1.1), (-1, 1.1)], [(0.9, -1), (1.1, -1), (1.1, 3), (0.9, 3)])
    assert cross == 0 and poly.area(SQUARE) == 4 == poly.area(SQUARE[::-1])


def test_winding_and_swap():
    random.seed(3)
    for _ in range(50):
        a = poly.hull(np.array([(random.random(), random.random()) for _ in range(6)]))
        b = poly.hull(np.array([(random.random() * 2, random.random() + 0.7) for _ in range(5)]))
        d = poly.polygon_gap(a, b)
        assert d >= 0 and abs(d - poly.polygon_gap(b[::-1], a)) < 1e-12


def test_column_form(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [0.0, 0.0, 1.0], [[3.0, 0.0, 0.0], [4.0, 0.0, 0.0], [4.0, 1.0, 0.0]]), ([0.0] * 3, [1.0] * 3, [0.0, 0.0, 1.0], None)], "lo array<double>, hi array<double>, n array<double>, p array<array<double>>")
    assert [r[0] for r in df.select(poly.in_plane_gap_general("lo", "hi", "n", "p")).collect()] == [2.0, None]


def test_manual_and_policies(spark):
    one = spark.createDataFrame([("s", "a"), ("s", "b")], "scene_id string, uid string")
    pairs = spark.createDataFrame([("s", "a", "b"), ("s", "a", "zz")], "scene_id string, src_uid string, tgt_uid string")
    assert {(r.tgt_uid, r.tgt_known) for r in correspond.manual(pairs, one, one).collect()} == {("b", True), ("zz", False)}
    df = spark.createDataFrame([("any_of_subset", ["a", "x"], ["a"]), ("one_of", ["a", "x"], ["a"]), ("all_of", ["a", "x"], ["a"]), ("exact", ["a"], ["a"]), ("abstain", [], ["a"])], "policy string, got array<string>, want array<string>")
    assert {r.policy: r.met for r in correspond.policy_score(df).collect()} == {"any_of_subset": False, "one_of": True, "all_of": True, "exact": True, "abstain": True}
    twice = spark.createDataFrame([("s", "a", "r"), ("s", "b", "r")], "scene_id string, uid string, source_ref string")
    try:
        correspond.by_source_ref(twice, twice).select(F.col("src_uid")).collect()
        raise AssertionError("no error")
    except Exception as e:  # noqa: BLE001
        assert "duplicate source reference" in str(e)


def test_policies_of_all_orders(spark, tmp_path):
    from roomscope import catalog

    rows = [(o, s, line) for o in (*range(1990, 2015), 5000, 123456) for line, s in enumerate(((o * 3 + k * k) % 50 for k in range(o % 7 + 1)), 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want, total = {}, [0, 0, 0]
    for o in {r[0] for r in rows}:
        got, wish = ({s % 7 for q, s, line in rows if q == o and ok(line)} for ok in (lambda x: x <= 3, lambda x: x >= 2))
        h, policy = len(got & wish), ("exact", "all_of", "one_of", "any_of_subset", "abstain")[o % 5]
        met = {"exact": got == wish, "all_of": wish <= got, "one_of": h > 0, "any_of_subset": h > 0 and got <= wish, "abstain": not got}[policy]
        want[o] = (policy, h, len(got - wish), met)
        total = [t + x for t, x in zip(total, (h, len(got), len(wish)), strict=True)]
    found = catalog.QUERIES["benchmark_policy"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {r.q: (r.policy, r.hits, r.extra, r.met) for r in found} == want
    both = next(r for r in catalog.QUERIES["micro_pr"](spark, str(tmp_path)).collect() if r.policy is None)
    assert [both.hits, both.cited, both.expected] == total and both.precision == total[0] / total[1] and both.recall == total[0] / total[2]
    assert "l_orderkey <=" not in catalog.ORACLES["benchmark_policy"] + catalog.ORACLES["micro_pr"]
