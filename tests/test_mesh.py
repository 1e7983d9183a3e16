from roomscope.operators import masks, mesh


def test_regions_and_planes(spark):
    v = [("s", i, float(i % 3), float(i // 3), 0.0) for i in range(9)] + [("s", 9, 0.0, 0.0, 1.0), ("s", 10, 2.0, 0.0, 1.0)]
    t = [("s", 0, 0, 1, 3), ("s", 1, 1, 4, 3), ("s", 2, 1, 2, 4), ("s", 3, 2, 5, 4), ("s", 4, 0, 9, 1), ("s", 5, 9, 10, 1), ("s", 6, 0, 0, 1)]
    vs = spark.createDataFrame(v, "scene_id string, vertex_id long, x double, y double, z double")
    ts = spark.createDataFrame(t, "scene_id string, face_id long, v0 long, v1 long, v2 long")
    f = mesh.face_geometry(vs, ts)
    assert f.count() == 6
    r = mesh.grow_regions(f, mesh.face_adjacency(ts.where("face_id < 6")))
    of = {x.face_id: x.region for x in r.collect()}
    assert len({of[i] for i in range(4)}) == 1 and of[4] == of[5] and of[0] != of[4]
    planes = {round(abs(p.c), 6) for p in mesh.plane_fits(f.join(r, ["scene_id", "face_id"]), ["scene_id", "region"]).collect()}
    assert 1.0 in planes and len(planes) == 2  # two faces alone leave the other plane open


def test_repair_v1(spark):
    rows = [("s", 1, i) for i in range(100)] + [("s", 2, i) for i in range(40)] + [("s", 3, i) for i in range(45, 85)] + [("s", 4, i) for i in range(30, 45)] + [("s", 5, i) for i in range(200, 260)] + [("s", 6, i) for i in range(200, 225)]
    mv = spark.createDataFrame(rows, "scene_id string, mask_id long, vertex_id long")
    m = spark.createDataFrame([("s", i, 0.9 if i == 1 else 0.5) for i in range(1, 7)], "scene_id string, mask_id long, score double")
    got = {r.mask_id: (r.score, r.became) for r in masks.repair_v1(m, mv).collect()}
    assert got == {1: (0.9, "parent"), 2: (0.9, "child"), 3: (0.9, "child"), 4: (0.5, "kept"), 5: (0.5, "kept"), 6: (0.5, "kept")}
