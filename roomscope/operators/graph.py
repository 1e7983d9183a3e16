"""Graph-level operators: canonical edges, support view, integrity, density, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVERSE = {"LEFT_OF": "RIGHT_OF", "RIGHT_OF": "LEFT_OF", "BEHIND": "IN_FRONT_OF", "IN_FRONT_OF": "BEHIND", "ABOVE": "BELOW", "BELOW": "ABOVE", "CONTAINS": "INSIDE", "INSIDE": "CONTAINS", "NEAR": "NEAR"}
#: The stored direction of each inverse pair when edges are counted logically.
CANONICAL = {"RIGHT_OF": "LEFT_OF", "IN_FRONT_OF": "BEHIND", "BELOW": "ABOVE", "INSIDE": "CONTAINS"}


def _map(names: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def canonical(edges: DataFrame) -> DataFrame:
    """Stored edges together with their inverses and the turned symmetric ones, each edge id once for a direction and type."""
    cols = ["scene_id", "type", "src_uid", "tgt_uid", "edge_id"]
    entity = edges.where("tgt_kind = 'entity'")
    turned = entity.withColumn("inverse", _map(INVERSE)[F.col("type")]).where("inverse is not null").select("scene_id", F.col("inverse").alias("type"), F.col("tgt_uid").alias("src_uid"), F.col("src_uid").alias("tgt_uid"), "edge_id")
    return entity.select(*cols).unionByName(turned).dropDuplicates(["scene_id", "type", "src_uid", "tgt_uid"])


def logical_count(edges: DataFrame) -> DataFrame:
    """Distinct edges per scene once inverse pairs are turned one way and symmetric pairs are unordered."""
    kind = F.coalesce(_map(CANONICAL)[F.col("type")], F.col("type"))
    flip = (kind != F.col("type")) | ((F.col("type") == "NEAR") & (F.col("src_uid") > F.col("tgt_uid")))
    return edges.groupBy("scene_id").agg(F.countDistinct(F.struct(kind, F.when(flip, F.col("tgt_uid")).otherwise(F.col("src_uid")), F.when(flip, F.col("src_uid")).otherwise(F.col("tgt_uid")))).alias("logical_edges"))


def density(logical: DataFrame, ents: DataFrame, limit: float = 14.0) -> DataFrame:
    """Edges per entity of each scene, from the scenes' numbers of logical edges."""
    n = ents.groupBy("scene_id").agg(F.count(F.lit(1)).alias("entities"))
    d = n.join(logical, "scene_id", "left").withColumn("logical_edges", F.coalesce("logical_edges", F.lit(0)))
    ratio = F.col("logical_edges") / F.col("entities")
    return d.select("scene_id", "entities", "logical_edges", ratio.alias("density"), (ratio <= limit).alias("within"))


def support_view(on_surf: DataFrame, on_ent: DataFrame) -> DataFrame:
    """Derived SUPPORTS facts; they are a view and never stored."""
    s = on_surf.select("scene_id", F.lit("surface").alias("supporter_kind"), F.col("tgt_uid").alias("supporter"), F.col("src_uid").alias("supported"), F.col("edge_id").alias("derived_from"))
    return s.unionByName(on_ent.select("scene_id", F.lit("entity").alias("supporter_kind"), F.col("tgt_uid").alias("supporter"), F.col("src_uid").alias("supported"), F.col("edge_id").alias("derived_from")))


def violations(edges: DataFrame, ents: DataFrame) -> DataFrame:
    """Duplicate edge ids, duplicate edge keys, stored SUPPORTS edges and dangling ends: must be empty."""
    ids = edges.groupBy("scene_id", "edge_id").count().where("count > 1").select("scene_id", F.lit("duplicate_id").alias("what"), F.col("edge_id").alias("ref"))
    keys = edges.groupBy("scene_id", "type", "src_uid", "tgt_kind", "tgt_uid").count().where("count > 1").select("scene_id", F.lit("duplicate_key").alias("what"), F.col("src_uid").alias("ref"))
    stored = edges.where("type = 'SUPPORTS'").select("scene_id", F.lit("stored_supports").alias("what"), F.col("edge_id").alias("ref"))
    ends = edges.select("scene_id", F.col("src_uid").alias("uid")).unionByName(edges.where("tgt_kind = 'entity'").select("scene_id", F.col("tgt_uid").alias("uid")))
    # Each end once, before it is looked up: there are far fewer ends than edges.
    loose = ends.distinct().join(ents.select("scene_id", "uid"), ["scene_id", "uid"], "left_anti").select("scene_id", F.lit("dangling").alias("what"), F.col("uid").alias("ref"))
    return ids.unionByName(keys).unionByName(stored).unionByName(loose)


def difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    a, b = one.select(*keys).distinct(), other.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("only_first")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("only_second")))


def edges_of(edges: DataFrame, uids: DataFrame, outgoing: bool = True) -> DataFrame:
    """Stored edges from (or to) the given entities (scene_id, uid)."""
    end = "src_uid" if outgoing else "tgt_uid"
    return edges.join(uids.select("scene_id", F.col("uid").alias(end)).distinct(), ["scene_id", end], "left_semi")


def rejection_samples(rejected: DataFrame, most: int = 64) -> DataFrame:
    """The first ``most`` rejections (scene_id, src_ordinal, tgt_ordinal, reason, ...) of each scene, in the order they are met."""
    from pyspark.sql import Window as W

    w = W.partitionBy("scene_id").orderBy("src_ordinal", "tgt_ordinal")
    return rejected.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def compact_context(first: DataFrame, ents: DataFrame, most: int = 8) -> DataFrame:
    """Each entity with its label and at most ``most`` of its relations, in the order of type and target, as texts. ``first``: scene_id,
    uid, type, tgt_ordinal of relations that hold these."""
    from pyspark.sql import Window as W

    w = W.partitionBy("scene_id", "uid").orderBy("type", "tgt_ordinal")
    few = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    few = few.join(ents.select("scene_id", F.col("ordinal").alias("tgt_ordinal"), F.col("label").alias("tgt_label")), ["scene_id", "tgt_ordinal"])
    listed = few.groupBy("scene_id", "uid").agg(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "type", "tgt_label").alias("t")))).alias("r"))
    return ents.select("scene_id", "uid", "label").join(listed, ["scene_id", "uid"], "left").select("scene_id", "uid", "label", F.coalesce(F.array_join(F.transform("r", lambda x: x["t"]), "; "), F.lit("")).alias("relations"))


def without_entities(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """A graph perturbed by leaving entities (scene_id, uid) and all their edges out."""
    names = gone.select("scene_id", "uid")
    left = edges.join(names.withColumnRenamed("uid", "src_uid"), ["scene_id", "src_uid"], "left_anti")
    return left.join(names.withColumnRenamed("uid", "tgt_uid"), ["scene_id", "tgt_uid"], "left_anti")


def scoped(edges: DataFrame, anchors: DataFrame, hops: int = 1) -> DataFrame:
    """Entities within so many edges of the anchors (scene_id, uid), with the least number of hops."""
    both = edges.select("scene_id", F.col("src_uid").alias("uid"), F.col("tgt_uid").alias("next")).unionByName(edges.select("scene_id", F.col("tgt_uid").alias("uid"), F.col("src_uid").alias("next"))).distinct()
    seen = anchors.select("scene_id", "uid").distinct().withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        reached = both.join(seen.where(F.col("hops") == k - 1), ["scene_id", "uid"]).select("scene_id", F.col("next").alias("uid"), F.lit(k).alias("hops"))
        seen = seen.unionByName(reached).groupBy("scene_id", "uid").agg(F.min("hops").alias("hops"))
    return seen
