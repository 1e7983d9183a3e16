"""Correspondence of bundles, and question scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomscope.functions import geometry as g
from roomscope.operators.joins import near_boxes
from roomscope.operators.masks import _settle


def by_source_ref(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs with equal, non-empty source references (scene_id, uid, source_ref); a reference used twice on a side is an error."""

    def checked(df: DataFrame, name: str) -> DataFrame:
        n = df.where("source_ref is not null and source_ref <> ''").groupBy("scene_id", "source_ref").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias(name))
        twice = F.raise_error(F.concat(F.lit("duplicate source reference "), F.col("source_ref"))).cast("string")
        return n.select("scene_id", "source_ref", F.when(F.col("n") == 1, F.col(name)).otherwise(twice).alias(name))

    return checked(one, "src_uid").join(checked(other, "tgt_uid"), ["scene_id", "source_ref"])


def manual(pairs: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """Given pairs (scene_id, src_uid, tgt_uid) with whether both ends are known."""
    a = one.select("scene_id", F.col("uid").alias("src_uid"), F.lit(True).alias("src_known"))
    b = other.select("scene_id", F.col("uid").alias("tgt_uid"), F.lit(True).alias("tgt_known"))
    return pairs.join(a, ["scene_id", "src_uid"], "left").join(b, ["scene_id", "tgt_uid"], "left").select("scene_id", "src_uid", "tgt_uid", F.coalesce("src_known", F.lit(False)).alias("src_known"), F.coalesce("tgt_known", F.lit(False)).alias("tgt_known"))


def policy_score(df: DataFrame) -> DataFrame:
    """Whether an answer meets its question's ambiguity policy: arrays ``got`` and ``want``, string ``policy``.

    exact: the same set. all_of: everything wanted, more is allowed. one_of: at least one, more is allowed. any_of_subset: at least
    one and nothing else. abstain: nothing.
    """
    hits, extra = F.size(F.array_intersect("got", "want")), F.size(F.array_except("got", "want"))
    ok = (
        F.when(F.col("policy") == "exact", (extra == 0) & (hits == F.size(F.array_distinct("want")))).when(F.col("policy") == "all_of", hits == F.size(F.array_distinct("want")))
        .when(F.col("policy") == "one_of", hits >= 1).when(F.col("policy") == "any_of_subset", (hits >= 1) & (extra == 0)).when(F.col("policy") == "abstain", F.size("got") == 0)
    )
    return df.withColumn("hits", hits).withColumn("extra", extra).withColumn("met", F.coalesce(ok, F.lit(False)))


def micro(df: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision and recall of arrays ``got`` and ``want`` by group and in all; null where nothing is counted."""
    hit, p, r = (F.sum(x) for x in (F.size(F.array_intersect("got", "want")), F.size("got"), F.size("want")))
    return df.rollup(*by).agg(hit.alias("hits"), p.alias("cited"), r.alias("expected")).withColumn("precision", F.when(F.col("cited") > 0, F.col("hits") / F.col("cited"))).withColumn("recall", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")))


def attribution(df: DataFrame) -> DataFrame:
    """Where a missed question failed: booleans hit, parsed, has_relation, dense."""
    why = F.when(F.col("hit"), "none").when(~F.col("parsed"), "parser").when(~F.col("has_relation"), "relation_extraction").when(F.col("dense"), "dense_graph").otherwise("scorer")
    return df.withColumn("attribution", why)


def iou_match(one: DataFrame, other: DataFrame, iou: float = 0.3, scale: float = 0.5, cap: float = 0.30) -> DataFrame:
    """One-to-one pairs of boxes of two bundles: by falling IoU from ``iou`` on, then, for sources without a partner in their order, the
    nearest free target by centroid within ``scale`` of the source's diagonal and ``cap``.

    Candidates come from the grid of near boxes. Both passes go in rounds that take every pair which is first at both its ends; the
    last pass's order (source by source) is kept by letting a pair wait while an earlier source still wants its target.
    """
    cols = ["scene_id", "ordinal", "uid", "lx", "ly", "lz", "hx", "hy", "hz", "cx", "cy", "cz"]
    last = one.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0]
    both = one.select(*cols).withColumn("side", F.lit(0)).unionByName(other.select(*cols).withColumn("ordinal", F.col("ordinal") + F.lit(last + 1)).withColumn("side", F.lit(1)))
    # The lower ordinal comes first in a near pair: the source. Centroids within the cap have boxes that overlap or nearly do.
    near = near_boxes(both, cap + 1e-9).where("a.side <> b.side")
    d = F.sqrt(sum(((F.col(f"a.c{k}") - F.col(f"b.c{k}")) * (F.col(f"a.c{k}") - F.col(f"b.c{k}")) for k in "xyz"), F.lit(0.0)))
    pairs = _settle(near.select(F.col("a.scene_id").alias("scene_id"), F.col("a.uid").alias("src_uid"), F.col("b.uid").alias("tgt_uid"), F.col("a.ordinal").alias("so"), F.col("b.ordinal").alias("to"), g.iou("a", "b").alias("iou"), d.alias("dist"), F.least(scale * g.diagonal("a"), F.lit(cap)).alias("most")))
    first = _first_at_both(pairs.where(F.col("iou") >= iou), [F.col("iou").desc(), "so", "to"], [F.col("iou").desc(), "so", "to"])
    rest = pairs.join(first.select("scene_id", "src_uid"), ["scene_id", "src_uid"], "left_anti").join(first.select("scene_id", "tgt_uid"), ["scene_id", "tgt_uid"], "left_anti").where("dist <= most")
    second = _first_at_both(rest, ["dist", "to"], ["so"])
    score = F.greatest(F.lit(0.0), F.when(F.col("most") > 0, 1.0 - F.col("dist") / F.col("most")).otherwise(0.0))
    return first.select("scene_id", "src_uid", "tgt_uid", F.lit("iou").alias("by"), F.col("iou").alias("score")).unionByName(second.select("scene_id", "src_uid", "tgt_uid", F.lit("centroid").alias("by"), score.alias("score")))


def _first_at_both(pairs: DataFrame, by_source: list, by_target: list) -> DataFrame:
    """Rounds until no pair is left: pairs that are first among their source's and first among their target's are taken. A source that
    waits for its target's earlier sources keeps its place; each round settles at least one pair of every scene."""
    from pyspark.sql import Window as W

    rest, taken = _settle(pairs), None
    while not rest.isEmpty():
        ranked = rest.withColumn("r1", F.row_number().over(W.partitionBy("scene_id", "src_uid").orderBy(*by_source))).withColumn("r2", F.row_number().over(W.partitionBy("scene_id", "tgt_uid").orderBy(*by_target)))
        now = _settle(ranked.where("r1 = 1 and r2 = 1").drop("r1", "r2"))
        taken = now if taken is None else taken.unionByName(now)
        rest = _settle(rest.join(now.select("scene_id", "src_uid"), ["scene_id", "src_uid"], "left_anti").join(now.select("scene_id", "tgt_uid"), ["scene_id", "tgt_uid"], "left_anti"))
    return taken if taken is not None else pairs
