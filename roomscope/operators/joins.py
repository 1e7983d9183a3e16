"""Band joins of entities inside a scene: by grid cells instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomscope.functions.geometry import AXES, box_gap, distance, square

#: Of a cell, so many rows meet so many of its neighbours' in one task; denser cells are split, so that no key holds more pairs.
LEFT, RIGHT = 8192, 2048


def split_cells(left: DataFrame, right: DataFrame, at: list[str], width: dict[str, Column] | None, left_most: int, right_most: int, half: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys on which they meet: each left row in its home cell, each right row in the cells around its own, and
    blocks of at most about so many rows of a cell. A left and a right row in neighbouring cells share exactly one key.

    ``at``: the three coordinates, ``width``: the cells' for each of them (None: a scene is one cell). With ``half`` right rows visit
    only cells before their own and, as ``same``, their own; so each two cells of the same table meet once.
    """
    cell = F.array(*[F.floor(F.col(c) / width[c]) for c in at]) if width else F.array(*[F.lit(0).cast("long")] * 3)
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if not half or (x, y, z) <= (0, 0, 0)] if width else [(0, 0, 0)]
    visits = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for v, k in zip(s, "xyz", strict=True)]) for s in steps]))
    g = ["gx", "gy", "gz"]
    one = left.withColumn("_c", cell).select("*", *[F.col("_c")[i].alias(k) for i, k in enumerate(g)]).drop("_c")
    other = right.withColumn("_c", cell).withColumn("_v", visits)
    other = other.select("*", *[(F.col("_c")[i] + F.col(f"_v.{k}")).alias(f"g{k}") for i, k in enumerate("xyz")], F.expr("_v.x = 0 and _v.y = 0 and _v.z = 0").alias("same")).drop("_c", "_v")
    keys = ["scene_id", *g]
    parts = lambda df, n, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / n).alias(name))
    cells = parts(one, left_most, "ni").join(parts(other, right_most, "nj"), keys)
    block = lambda n: F.pmod(F.xxhash64("ordinal"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = one.join(cells, keys).withColumn("i", block("ni")).withColumn("j", every("nj")).drop("ni", "nj")
    other = other.join(cells, keys).withColumn("j", block("nj")).withColumn("i", every("ni")).drop("ni", "nj")
    return one, other, [*keys, "i", "j"]


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dealt by the keys of blocks to a number of tasks that stays: rows are few, their pairs are the work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * spark.sparkContext.defaultParallelism), *keys)


def _met(ents: DataFrame, at: list[str], width: dict[str, Column], far: Column, name: str, close: Column, cols: list[str] | None) -> DataFrame:
    """Pairs of entities in neighbouring cells that are ``close``, each once and in either order, as structs a and b of the wanted columns,
    with ``far`` by its name and whether a comes ``first`` by ordinal. Both are told from flat columns _l_... and _r_...: only what passes
    is made into structs, and large expressions (which the JVM would not compile) stay out of the join."""
    cols = cols or [c for c in ents.columns if not c.startswith("_w")]
    needed = [c for c in ents.columns if c in {*cols, *at, "ordinal", *(f"{e}{k}" for e in "lhc" for k in AXES)}]
    left, right, keys = split_cells(ents, ents, at, width, LEFT, RIGHT, half=True)
    left = dealt(left, keys).select(*keys, *[F.col(c).alias(f"_l_{c}") for c in needed])
    right = dealt(right, keys).select(*keys, "same", *[F.col(c).alias(f"_r_{c}") for c in needed])
    met = left.join(right, keys).where("_l_ordinal < _r_ordinal or (not same and _l_ordinal > _r_ordinal)").where(close)
    end = lambda x: F.struct(*[F.col(f"_{x}_{c}").alias(c) for c in cols])
    return met.select(end("l").alias("a"), end("r").alias("b"), far.alias(name), (F.col("_l_ordinal") < F.col("_r_ordinal")).alias("first"))


def _ordered(pairs: DataFrame, name: str) -> DataFrame:
    one, other = F.when(F.col("first"), F.col("a")).otherwise(F.col("b")), F.when(F.col("first"), F.col("b")).otherwise(F.col("a"))
    return pairs.select(one.alias("a"), other.alias("b"), name)


def near_points(ents: DataFrame, radius: float, inclusive: bool = False, strategy: str = "grid", cols: list[str] | None = None, either: bool = False) -> DataFrame:
    """Pairs a, b (a before b by ordinal) of centroids closer than ``radius``, as structs a and b (of ``cols``, else all) and ``dist``.

    Each centroid has one home cell as wide as the radius; only b visits the cells around its own. With ``either`` a and b come as they
    are met, with whether a is ``first``.
    """
    limit = lambda d: d <= radius if inclusive else d < radius
    if strategy == "nested":
        pairs = _structs(ents, "a").join(_structs(ents, "b"), F.expr("a.scene_id = b.scene_id and a.ordinal < b.ordinal")).withColumn("dist", distance("a", "b")).withColumn("first", F.lit(True))
        pairs = pairs.where(limit(F.col("dist")))
        return pairs if either else pairs.drop("first")
    at = [f"c{k}" for k in AXES]
    x, y, z = (square(F.col(f"_l_{c}") - F.col(f"_r_{c}")) for c in at)
    dist = F.sqrt(x + y + z)
    pairs = _met(ents, at, {c: F.lit(radius) for c in at}, dist, "dist", limit(dist), cols)
    return pairs if either else _ordered(pairs, "dist")


def near_boxes(ents: DataFrame, gap: float, strategy: str = "grid", ordered: bool = True, cols: list[str] | None = None, either: bool = False) -> DataFrame:
    """Pairs of boxes with surfaces less than ``gap`` apart, as structs a and b (of ``cols``, else all) and ``gap``.

    A cell is as wide as the gap and the scene's largest box together, so that the low corners of such boxes lie in neighbouring
    cells. With ``ordered`` a comes before b; else both orders are returned. ``either`` is as in near_points.
    """
    if strategy == "nested":
        pairs = _structs(ents, "a").join(_structs(ents, "b"), F.expr("a.scene_id = b.scene_id and a.ordinal < b.ordinal")).withColumn("gap", box_gap("a", "b")).where(F.col("gap") < gap).withColumn("first", F.lit(True))
        pairs = pairs if either else pairs.drop("first")
    else:
        size = ents.groupBy("scene_id").agg(*[F.max(F.col(f"h{k}") - F.col(f"l{k}")).alias(f"_w{k}") for k in AXES])
        x, y, z = (square(F.greatest(F.lit(0.0), F.col(f"_l_l{k}") - F.col(f"_r_h{k}"), F.col(f"_r_l{k}") - F.col(f"_l_h{k}"))) for k in AXES)
        far = F.sqrt(x + y + z)
        pairs = _met(ents.join(size, "scene_id"), [f"l{k}" for k in AXES], {f"l{k}": F.col(f"_w{k}") + gap for k in AXES}, far, "gap", far < gap, cols)
        pairs = pairs if either else _ordered(pairs, "gap")
    return pairs if ordered else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))


def _structs(ents: DataFrame, name: str) -> DataFrame:
    return ents.select(F.struct(*ents.columns).alias(name))


def with_surfaces(ents: DataFrame, surfs: DataFrame) -> DataFrame:
    """Every entity with every surface of its scene, as structs e and s: a scene has a few dozen surfaces."""
    return ents.select("scene_id", F.struct(*ents.columns).alias("e")).join(surfs.select("scene_id", F.struct(*surfs.columns).alias("s")), "scene_id")
