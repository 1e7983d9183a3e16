"""Scene files as tables (IO1, IO5, IO6, IO12, IO13, IO15, W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SCENE_GRAPH = T.StructType([
    T.StructField("scene", T.StringType()),
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("xyz", T.ArrayType(T.DoubleType())),
        T.StructField("attributes", T.StructType([T.StructField("type", T.StringType()), T.StructField("bbox_sizes", T.ArrayType(T.DoubleType()))])),
    ]))),
])
BUNDLE_VERSION = 1


def base_label(label):
    """The label without a number behind an underscore."""
    return F.regexp_replace(label, r"_\d+$", "")


def read_scene_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Entities of scene-graph JSON files: the box is the position plus and minus half the size; the file's order is kept."""
    raw = spark.read.schema(SCENE_GRAPH).json(path, multiLine=True)
    o = raw.select(F.col("scene").alias("scene_id"), F.posexplode("objects").alias("ordinal", "o"))
    size = lambda i: F.coalesce(F.col("o.attributes.bbox_sizes")[i], F.lit(0.1)) / 2
    at = lambda i: F.col("o.xyz")[i]
    return o.select(
        "scene_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("o.id").alias("uid"), base_label(F.col("o.label")).alias("class"), F.col("o.label").alias("label"),
        *[(at(i) - size(i)).alias(f"l{k}") for i, k in enumerate("xyz")], *[(at(i) + size(i)).alias(f"h{k}") for i, k in enumerate("xyz")], *[at(i).alias(f"c{k}") for i, k in enumerate("xyz")],
    )


def number_duplicates(ents: DataFrame) -> DataFrame:
    """Labels that occur more than once in a scene get _1, _2 and so on, in order."""
    w = W.partitionBy("scene_id", "class")
    n = F.count(F.lit(1)).over(w)
    return ents.withColumn("numbered", F.when(n > 1, F.concat_ws("_", "class", F.row_number().over(w.orderBy("ordinal")).cast("string"))).otherwise(F.col("class")))


def dominant_yaw(walls: DataFrame) -> DataFrame:
    """Length-weighted mean direction of walls modulo a quarter turn, in degrees of [-45, 45); applied from 5 degrees on."""
    theta = 4 * F.atan2("ny", "nx")
    deg = F.degrees(F.atan2(F.sum(F.col("length") * F.sin(theta)), F.sum(F.col("length") * F.cos(theta))) / 4)
    return walls.groupBy("scene_id").agg(deg.alias("yaw")).withColumn("applied", F.abs("yaw") >= 5)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A bundle as Parquet folders that carry their schema version; edges are laid out by scene and type."""
    for name, df in tables.items():
        w = df.withColumn("schema_version", F.lit(BUNDLE_VERSION)).write.mode("overwrite")
        (w.partitionBy("scene_id", "type") if name == "edge" else w.partitionBy("scene_id")).parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a bundle; a row of another schema version is an error."""
    df = spark.read.parquet(f"{path}/{name}")
    bad = F.raise_error(F.concat(F.lit("unknown schema version "), F.col("schema_version").cast("string")))
    return df.withColumn("schema_version", F.when(F.col("schema_version") == BUNDLE_VERSION, F.col("schema_version")).otherwise(bad.cast("int")))


def oriented_bounds(boxes: DataFrame) -> DataFrame:
    """Bounds of boxes turned about z: x, y, half sizes ex and ey, yaw in radians, by their four corners."""
    c, s = F.cos("yaw"), F.sin("yaw")
    xs = [F.col("x") + a * F.col("ex") * c - b * F.col("ey") * s for a in (-1, 1) for b in (-1, 1)]
    ys = [F.col("y") + a * F.col("ex") * s + b * F.col("ey") * c for a in (-1, 1) for b in (-1, 1)]
    return boxes.select("*", F.least(*xs).alias("lx"), F.greatest(*xs).alias("hx"), F.least(*ys).alias("ly"), F.greatest(*ys).alias("hy"))


def nearest_reference(walls: DataFrame, refs: DataFrame) -> DataFrame:
    """For each wall the nearest reference in the plane, the first of equals: its interior side looks there."""
    w = walls.select("scene_id", "suid", ((F.col("plx") + F.col("phx")) / 2).alias("wx"), ((F.col("ply") + F.col("phy")) / 2).alias("wy"))
    both = w.join(refs.select("scene_id", "uid", "ordinal", "cx", "cy"), "scene_id")
    d2 = (F.col("wx") - F.col("cx")) * (F.col("wx") - F.col("cx")) + (F.col("wy") - F.col("cy")) * (F.col("wy") - F.col("cy"))
    return both.groupBy("scene_id", "suid").agg(F.min_by("uid", F.struct(d2.alias("d2"), "ordinal")).alias("floor_uid"))


def floor_shift(ents: DataFrame, surfs: DataFrame, reach: float = 0.5, cluster: float = 0.06, voters: int = 3, least: float = -0.10) -> DataFrame:
    """How far the floor should move: the median bottom of the lowest cluster of things over it, applied if enough and far."""
    from roomscope.functions import geometry as g
    from roomscope.operators.joins import with_surfaces

    low, _ = g.corner_distances("e", "s")
    over = with_surfaces(ents, surfs.where("stype = 'floor'")).where((g.mid("e", "x") >= F.col("s.plx")) & (g.mid("e", "x") <= F.col("s.phx")) & (g.mid("e", "y") >= F.col("s.ply")) & (g.mid("e", "y") <= F.col("s.phy")))
    votes = over.select("scene_id", low.alias("bottom")).where(F.abs("bottom") <= reach)
    least_of = votes.groupBy("scene_id").agg(F.min("bottom").alias("first"))
    near = votes.join(least_of, "scene_id").where(F.col("bottom") <= F.col("first") + cluster)
    out = near.groupBy("scene_id").agg(F.count(F.lit(1)).alias("voters"), F.percentile("bottom", 0.5).alias("shift"))
    return out.withColumn("applied", (F.col("shift") < least) & (F.col("voters") >= voters))
