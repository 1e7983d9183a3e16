"""Relation families (J1 to J13): each returns edges, with the evidence that decided them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomscope.functions import geometry as g
from roomscope.operators.joins import LEFT, RIGHT, dealt, near_boxes, near_points, split_cells, with_surfaces

SUPPORTERS = ("table", "desk", "chair", "stool", "bench", "shelf", "sofa", "plant-stand", "counter")
SUPPORTERS_V2 = (*SUPPORTERS, "cabinet", "nightstand", "bed")
POINT = ["scene_id", "uid", "cx", "cy", "cz"]
NEAR_LIMITS = {"floor": 0.05, "wall": 0.30, "ceiling": 0.10}


def edge_id(extractor: str, version: str, src: Column, kind: Column, tgt_kind: str, tgt: Column) -> Column:
    text = F.concat_ws("|", F.lit(extractor), F.lit(version), F.concat(F.lit("entity:"), src), kind, F.concat(F.lit(f"{tgt_kind}:"), tgt))
    return F.concat(F.lit("e_"), F.substring(F.sha2(text, 256), 1, 16))


def _edges(df: DataFrame, extractor: str, version: str, kind: Column, src: Column, tgt: Column, tgt_kind: str = "entity", **evidence: Column) -> DataFrame:
    return df.select(
        F.col("scene_id"), kind.alias("type"), src.alias("src_uid"), F.lit(tgt_kind).alias("tgt_kind"), tgt.alias("tgt_uid"),
        edge_id(extractor, version, src, kind, tgt_kind, tgt).alias("edge_id"), *[c.alias(n) for n, c in evidence.items()],
    )


def _dominant(df: DataFrame) -> DataFrame:
    """axis and delta of the largest absolute centroid difference a - b; ties go to x, then y."""
    d = {k: g.mid("a", k) - g.mid("b", k) for k in g.AXES}
    m = F.greatest(*[F.abs(x) for x in d.values()])
    return df.withColumn("axis", F.when(F.abs(d["x"]) == m, "x").when(F.abs(d["y"]) == m, "y").otherwise("z")).withColumn("delta", F.when(F.abs(d["x"]) == m, d["x"]).when(F.abs(d["y"]) == m, d["y"]).otherwise(d["z"]))


def directional_compat(ents: DataFrame, least: float = 0.3) -> DataFrame:
    """Both directions of every pair of a scene along its dominant axis. The result itself has a row for nearly every pair."""
    pairs = ents.select("scene_id", F.struct(*ents.columns).alias("a")).join(ents.select("scene_id", F.struct(*ents.columns).alias("b")), "scene_id").where("a.ordinal <> b.ordinal")
    kind = (
        F.when((F.col("axis") == "x") & (F.col("delta") < 0), "LEFT_OF").when(F.col("axis") == "x", "RIGHT_OF")
        .when((F.col("axis") == "y") & (F.col("delta") < 0), "BEHIND").when(F.col("axis") == "y", "IN_FRONT_OF")
        .when(F.col("delta") < 0, "BELOW").otherwise("ABOVE")
    )
    found = _dominant(pairs).where(F.abs("delta") >= least)
    return _edges(found, "directional", "0.1", kind, F.col("a.uid"), F.col("b.uid"))


def directional_sparse(ents: DataFrame, reach: float = 2.5, least: float = 0.5, strategy: str = "grid", carry: tuple[str, ...] = ()) -> DataFrame:
    """One canonical edge (LEFT_OF, BEHIND, ABOVE) for each pair within reach whose dominant difference is large enough. Columns of the
    entities in ``carry`` come along as src_... and tgt_..., so that nothing has to be joined to the edges.

    In small steps, each of which the JVM can compile: there may be very many pairs.
    """
    pairs = near_points(ents, reach, inclusive=True, strategy=strategy, cols=[*POINT, *carry], either=True)
    ends = ["uid", *carry]
    d = pairs.select(F.col("a.scene_id").alias("scene_id"), "dist", *[(g.mid("a", k) - g.mid("b", k)).alias(f"d{k}") for k in g.AXES], *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for c in ends for e in "ab"])
    d = d.withColumns({f"m{k}": F.abs(f"d{k}") for k in g.AXES}).where(F.greatest("mx", "my", "mz") >= least)
    d = d.withColumn("axis", F.when((F.col("mx") >= F.col("my")) & (F.col("mx") >= F.col("mz")), 0).when(F.col("my") >= F.col("mz"), 1).otherwise(2))
    d = d.withColumn("forward", F.when(F.col("axis") == 2, F.col("dz") > 0).when(F.col("axis") == 1, F.col("dy") < 0).otherwise(F.col("dx") < 0))
    kind = F.when(F.col("axis") == 0, "LEFT_OF").when(F.col("axis") == 1, "BEHIND").otherwise("ABOVE")
    end = lambda one, other, c: F.when(F.col("forward"), F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))
    found = d.select("scene_id", "dist", kind.alias("kind"), *[end(*x, c).alias(f"{n}_{c}") for n, x in (("src", "ab"), ("tgt", "ba")) for c in ends])
    return _edges(found, "directional", "0.1", F.col("kind"), F.col("src_uid"), F.col("tgt_uid"), dist=F.col("dist"), **_carried(carry))


def _carried(carry: tuple[str, ...]) -> dict[str, Column]:
    return {f"{n}_{c}": F.col(f"{n}_{c}") for n in ("src", "tgt") for c in carry}


def _first_ends(pairs: DataFrame, what: str | Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs met in either order, from the first to the second, as flat columns."""
    end = lambda one, other, c: F.when(F.col("first"), F.col(f"{one}.{c}")).otherwise(F.col(f"{other}.{c}"))
    return pairs.select(F.col("a.scene_id").alias("scene_id"), what, *[end(*x, c).alias(f"{n}_{c}") for n, x in (("src", "ab"), ("tgt", "ba")) for c in ("uid", *carry)])


def directional_rejections(ents: DataFrame, reach: float = 2.5, least: float = 0.5) -> DataFrame:
    """Counts by scene and reason. What is out of reach is all pairs less those within it, so no such pair is made."""
    near = near_points(ents, reach, inclusive=True, cols=POINT).withColumn("scene_id", F.col("a.scene_id"))
    kept = _dominant(near).groupBy("scene_id").agg(F.count(F.lit(1)).alias("near"), F.count(F.when(F.abs("delta") < least, 1)).alias("weak"))
    n = ents.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(kept, "scene_id", "left").select("scene_id", (F.expr("n * (n - 1) div 2") - F.coalesce("near", F.lit(0))).alias("far"), F.coalesce("weak", F.lit(0)).alias("weak"))
    return both.select("scene_id", F.expr("stack(2, 'distance', far, 'no_dominant_axis', weak) as (reason, n)")).select("scene_id", F.lit("LEFT_OF").alias("type"), "reason", F.col("n").cast("long").alias("n"))


def near_compat(ents: DataFrame, radius: float = 1.0) -> DataFrame:
    """Both directions of each near pair, which is found once."""
    found = _first_ends(near_points(ents, radius, cols=["scene_id", "uid"], either=True), "dist")
    ways = F.explode(F.array(*[F.struct(F.col(f"{x}_uid").alias("src_uid"), F.col(f"{y}_uid").alias("tgt_uid")) for x, y in (("src", "tgt"), ("tgt", "src"))]))
    both = found.select("scene_id", "dist", ways.alias("way")).select("scene_id", "dist", "way.*")
    return _edges(both, "proximity", "0.1", F.lit("NEAR"), F.col("src_uid"), F.col("tgt_uid"), dist=F.col("dist"))


def near_sparse(ents: DataFrame, radius: float = 1.0, strategy: str = "grid", carry: tuple[str, ...] = ()) -> DataFrame:
    found = _first_ends(near_points(ents, radius, strategy=strategy, cols=["scene_id", "uid", *carry], either=True), "dist", carry)
    return _edges(found, "proximity", "0.1", F.lit("NEAR"), F.col("src_uid"), F.col("tgt_uid"), dist=F.col("dist"), **_carried(carry))


def near_sparse_v2(ents: DataFrame, gap: float = 1.0, strategy: str = "grid") -> DataFrame:
    found = _first_ends(near_boxes(ents, gap, strategy, cols=["scene_id", "uid"], either=True), "gap")
    return _edges(found, "proximity", "0.2-sparse_v2", F.lit("NEAR"), F.col("src_uid"), F.col("tgt_uid"), dist=F.col("gap"))


def near_by_either(ents: DataFrame, radius: float = 1.0, gap: float = 0.5) -> DataFrame:
    """scene_id, src_uid, tgt_uid, by_point, by_box of the pairs that near_sparse or near_sparse_v2 would take, from one band join: boxes
    are no farther apart than their centroids."""
    pairs = near_boxes(ents, max(radius, gap) * (1 + 1e-9), cols=POINT, either=True).withColumn("dist", g.distance("a", "b"))
    both = _first_ends(pairs, F.struct((F.col("dist") < radius).alias("by_point"), (F.col("gap") < gap).alias("by_box")).alias("by")).select("scene_id", "src_uid", "tgt_uid", "by.*")
    return both.where("by_point or by_box")


def near_surface(ents: DataFrame, surfs: DataFrame, polygon: bool = False) -> DataFrame:
    limit = F.coalesce(*[F.when(F.col("s.stype") == t, F.lit(x)) for t, x in NEAR_LIMITS.items()])
    dist = g.box_surface("e", "s") if polygon else g.box_plane("e", "s")
    found = with_surfaces(ents, surfs).withColumn("dist", dist).where(F.col("dist") <= limit)
    return _edges(found, "surface", "0.2-near_surface_polygon_clipped" if polygon else "0.1", F.lit("NEAR_SURFACE"), F.col("e.uid"), F.col("s.suid"), "surface", dist=F.col("dist"))


def judged(ents: DataFrame, surfs: DataFrame, clauses) -> DataFrame:
    """Every entity and surface of a scene with the clauses that fail."""
    return with_surfaces(ents, surfs).withColumn("failed", g.failed(clauses("e", "s")))


def on_surface(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    found = judged(ents, surfs.where("plx is not null"), g.rest_clauses).where(F.size("failed") == 0)
    return _edges(found, "on_surface", "0.1", F.lit("ON_SURFACE"), F.col("e.uid"), F.col("s.suid"), "surface")


def contacts_surface(ents: DataFrame, surfs: DataFrame, exclude_flat: bool = False) -> DataFrame:
    walls = surfs.where("stype = 'wall' and plx is not null")
    found = judged(ents, walls, g.wall_clauses).where(F.size("failed") == 0)
    if exclude_flat:
        found = found.join(wall_extent(surfs), "scene_id", "left").where(~g.room_scale_flat("e", F.col("area")))
    return _edges(found, "contacts_surface", "0.1", F.lit("CONTACTS_SURFACE"), F.col("e.uid"), F.col("s.suid"), "surface")


def contact_rejections(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    """Rejected pairs by reason, and for failed clauses by which."""
    kind = F.when(F.col("s.stype") != "wall", "surface_type_not_wall").when(F.col("s.plx").isNull(), "polygon_required").otherwise("wall_contact_clauses_failed")
    found = judged(ents, surfs, g.wall_clauses).withColumn("reason", kind).where(~((F.col("s.stype") == "wall") & (F.size("failed") == 0)))
    clauses = F.when(F.col("reason") == "wall_contact_clauses_failed", F.array_join("failed", ",")).otherwise("")
    return found.groupBy("scene_id", "reason", clauses.alias("clauses")).agg(F.count(F.lit(1)).alias("n"))


def wall_extent(surfs: DataFrame) -> DataFrame:
    """Area of the rectangle around all wall polygons; a scene without walls has no row."""
    return surfs.where("stype = 'wall' and plx is not null").groupBy("scene_id").agg(((F.max("phx") - F.min("plx")) * (F.max("phy") - F.min("ply"))).alias("area"))


def entity_tops(ents: DataFrame, allowed: tuple[str, ...] = SUPPORTERS) -> DataFrame:
    """The top face of every supporting entity, as a surface of its owner."""
    return ents.where(F.col("class").isin(*allowed)).select(
        "scene_id", "ordinal", F.concat(F.lit("ent_surf_"), "uid", F.lit("_top")).alias("suid"), F.col("uid").alias("owner_uid"), F.col("class").alias("owner_class"), F.lit("entity_top").alias("stype"),
        F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), (-F.col("hz")).alias("d"),
        F.col("lx").alias("plx"), F.col("ly").alias("ply"), F.col("hz").alias("plz"), F.col("hx").alias("phx"), F.col("hy").alias("phy"), F.col("hz").alias("phz"),
    )


def on_entity_surface(ents: DataFrame, allowed: tuple[str, ...] = SUPPORTERS) -> DataFrame:
    """Entities of no supporting class that rest on the top of one that is. Candidates are those whose foot is about as high as the top."""
    class_, box = F.col("class"), ["ordinal", "uid", *(f"{e}{k}" for e in "lhc" for k in g.AXES)]
    foot, top = ents.where(~class_.isin(*allowed)).withColumn("_z", F.col("lz")), ents.where(class_.isin(*allowed)).withColumn("_z", F.col("hz"))
    pairs = near_heights(foot, top, 0.05, box)
    top = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("c"), (-F.col("b.hz")).alias("d"), F.col("b.lx").alias("plx"), F.col("b.ly").alias("ply"), F.col("b.hz").alias("plz"), F.col("b.hx").alias("phx"), F.col("b.hy").alias("phy"), F.col("b.hz").alias("phz"))
    found = pairs.withColumn("s", top).withColumn("failed", g.failed(g.rest_clauses("a", "s"))).where(F.size("failed") == 0).withColumn("scene_id", F.col("a.scene_id"))
    return _edges(found, "on_entity_surface", "0.1", F.lit("ON_ENTITY_SURFACE"), F.col("a.uid"), F.col("b.uid"))


def near_heights(a: DataFrame, b: DataFrame, band: float, cols: list[str]) -> DataFrame:
    """Pairs of different boxes of two tables whose heights _z differ by at most ``band`` and whose shadows may touch, as structs a and b: by
    cells that are a band high and as wide as the scene's largest box."""
    size = a.select("scene_id", *[F.col(f"h{k}") - F.col(f"l{k}") for k in "xy"]).toDF("scene_id", "x", "y").unionByName(b.select("scene_id", *[F.col(f"h{k}") - F.col(f"l{k}") for k in "xy"]).toDF("scene_id", "x", "y"))
    size = size.groupBy("scene_id").agg(*[F.max(k).alias(f"_w{k}") for k in "xy"])
    width = {"lx": F.col("_wx") + band, "ly": F.col("_wy") + band, "_z": F.lit(band)}
    one, other, keys = split_cells(a.join(size, "scene_id"), b.join(size, "scene_id"), list(width), width, LEFT, RIGHT)
    one = dealt(one, keys).select(*keys, F.struct("scene_id", *cols).alias("a"))
    other = dealt(other, keys).select(*keys, F.struct("scene_id", *cols).alias("b"))
    return one.join(other, keys).where("a.lx <= b.hx and b.lx <= a.hx and a.ly <= b.hy and b.ly <= a.hy and a.ordinal <> b.ordinal").select("a", "b")


def floor_support(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    """Per entity the lowest gap over floors it is above and over, and whether that makes it stand (however deep it sinks)."""
    clauses = dict(g.rest_clauses("e", "s"))
    low, _ = g.corner_distances("e", "s")
    over = with_surfaces(ents, surfs.where("stype = 'floor'")).where(clauses["support_capable"] & clauses["centroid_on_support_side"] & clauses["footprint_ok"])
    return over.groupBy("scene_id", F.col("e.uid").alias("uid")).agg(F.min(low).alias("floor_gap")).withColumn("supported", F.col("floor_gap") <= 0.02)


def attached_judged(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    walls = judged(ents, surfs.where("stype = 'wall'"), g.wall_clauses)
    return walls.withColumn("uid", F.col("e.uid")).join(floor_support(ents, surfs), ["scene_id", "uid"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def attached_to(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    """In contact with a wall and not standing on a floor."""
    found = attached_judged(ents, surfs).where((F.size("failed") == 0) & ~F.col("supported"))
    return _edges(found, "attached_to", "0.1", F.lit("ATTACHED_TO"), F.col("e.uid"), F.col("s.suid"), "surface")


def attached_to_v2(ents: DataFrame, surfs: DataFrame, contact: float = 0.12, depth: float = 0.35, elevated: float = 0.30, panel: float = 0.12) -> DataFrame:
    """Per entity and wall the first reason against an attachment, or null where it is attached."""
    floor = surfs.where("stype = 'floor' and abs(c) >= 1e-9").groupBy("scene_id").agg(F.min_by(F.struct("a", "b", "c", "d"), "ordinal").alias("f"))
    walls = judged(ents, surfs.where("stype = 'wall'"), lambda e, s: g.wall_clauses(e, s, contact=contact, penetration=contact)).join(floor, "scene_id", "left")
    height = g.lo("e", "z") - (-(F.col("f.a") * g.mid("e", "x") + F.col("f.b") * g.mid("e", "y") + F.col("f.d")) / F.col("f.c"))
    deep = g.depth_along_normal("e", "s")
    reason = (
        F.when(F.size("failed") > 0, "wall_contact_clauses_failed").when(deep > depth, "depth_exceeds_max").when(F.col("f").isNull(), "no_calibrated_floor_plane")
        .when((height < elevated) & (deep > panel), "low_but_not_thin_panel")
    )
    return walls.select("scene_id", F.col("e.uid").alias("src_uid"), F.col("s.suid").alias("tgt_uid"), reason.alias("reason"))


def on_entity_surface_v2(ents: DataFrame, surfs: DataFrame, share: float = 0.5, band: float = 0.02) -> DataFrame:
    """The first rule with more supporters, or contained: inside the smallest qualifying supporter's outline and height."""
    first = on_entity_surface(ents, SUPPORTERS_V2).select("scene_id", "src_uid", "tgt_uid", F.lit("top").alias("rule"))
    free = ents.join(floor_support(ents, surfs).where("supported").select("scene_id", "uid"), ["scene_id", "uid"], "left_anti")
    # Containment means the boxes touch, so the same band join finds all candidates.
    pairs = near_boxes(ents, 0.05, ordered=False).where(F.col("b.class").isin(*SUPPORTERS_V2))
    ok = (
        (g.mid("a", "x") >= g.lo("b", "x")) & (g.mid("a", "x") <= g.hi("b", "x")) & (g.mid("a", "y") >= g.lo("b", "y")) & (g.mid("a", "y") <= g.hi("b", "y"))
        & (g.footprint("b") > 0) & (g.footprint("a") <= share * g.footprint("b")) & (g.lo("a", "z") >= g.lo("b", "z")) & (g.lo("a", "z") <= g.hi("b", "z") + band)
    )
    best = pairs.where(ok).groupBy(F.col("a.scene_id").alias("scene_id"), F.col("a.uid").alias("src_uid")).agg(F.min_by(F.col("b.uid"), F.struct(g.footprint("b").alias("f"), F.col("b.uid").alias("u"))).alias("tgt_uid"))
    best = best.join(free.select("scene_id", F.col("uid").alias("src_uid")), ["scene_id", "src_uid"], "left_semi")
    return first.unionByName(best.join(first, ["scene_id", "src_uid", "tgt_uid"], "left_anti").withColumn("rule", F.lit("contained")))
