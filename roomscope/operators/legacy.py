"""The older retrieval path: parse, score each node, take the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roomscope.operators import pairwise
from roomscope.operators.reason import normalised

# Words, phrases, weights and numbers of answers that results depend on.
COLOURS = ("black", "red", "silver", "white", "wooden")
ZONES = [
    ("back wall", "back_wall"), ("right brick wall", "right_brick_wall"), ("right wall", "right_wall"), ("left wall", "left_wall"), ("front right", "front_right"), ("ceiling", "ceiling_center"),
]
SPATIAL = [
    (r"what(?:\'s| is) (?:to the )?left of (?:the )?([a-z0-9 _]+?)(?:\?|$)", "LEFT_OF"), (r"what(?:\'s| is) (?:to the )?right of (?:the )?([a-z0-9 _]+?)(?:\?|$)", "RIGHT_OF"),
    (r"what(?:\'s| is) below (?:the )?([a-z0-9 _]+?)(?:\?|$)", "BELOW"), (r"what(?:\'s| is) under (?:the )?([a-z0-9 _]+?)(?:\?|$)", "BELOW"), (r"what(?:\'s| is) above (?:the )?([a-z0-9 _]+?)(?:\?|$)", "ABOVE"),
    (r"what(?:\'s| is) in front of (?:the )?([a-z0-9 _]+?)(?:\?|$)", "IN_FRONT_OF"), (r"what(?:\'s| is) behind (?:the )?([a-z0-9 _]+?)(?:\?|$)", "BEHIND"),
]
NEAR = r"near\s+(?:the\s+)?([a-z0-9 _]+)"
K_OF = {"describe_near_anchor": 10, "describe_near_zone": 10, "describe_zone": 10, "describe_spatial": 6}
LABEL, COLOUR, NEAR_ANCHOR, OTHER_ANCHOR = 0.75, 0.25, 0.45, 0.22


def parse(questions: DataFrame, labels: list[str]) -> DataFrame:
    """intent, colour, relation, anchor, zone and target of legacy questions, by rules in their order; labels in the order given."""
    q = normalised(F.col("text"))
    zone = F.coalesce(*[F.when(F.contains(q, F.lit(x)), z) for x, z in ZONES])
    relation = F.coalesce(*[F.when(q.rlike(r), x) for r, x in SPATIAL])
    related = F.coalesce(*[F.when(q.rlike(r), F.trim(F.regexp_extract(q, r, 1))) for r, _ in SPATIAL])
    near = F.nullif(F.trim(F.regexp_extract(q, NEAR, 1)), F.lit(""))
    asks_near = F.startswith(q, F.lit("what is near")) | F.startswith(q, F.lit("what's near"))
    on_wall = F.contains(q, F.lit("on the")) & F.contains(q, F.lit("wall"))
    intent = (
        F.when(on_wall, "describe_zone").when(relation.isNotNull(), "describe_spatial")
        .when((F.contains(q, F.lit("what is near")) | F.contains(q, F.lit("what's near"))) & zone.isNotNull(), "describe_near_zone").when(asks_near, "describe_near_anchor")
        .when(F.contains(q, F.lit("where")), "find_location").when(F.contains(q, F.lit("what")), "describe").otherwise("find_object")
    )
    free = F.col("intent").isin("find_location", "describe", "find_object")
    target = F.coalesce(*[F.when(F.contains(q, F.lit(x)), x) for x in labels])
    return questions.withColumn("intent", intent).select(
        "question_id", "text", "intent", F.coalesce(*[F.when(F.contains(q, F.lit(c)), c) for c in COLOURS]).alias("colour"), F.when(F.col("intent") == "describe_spatial", relation).alias("relation"),
        F.when(F.col("intent") == "describe_spatial", related).when(free | (F.col("intent") == "describe_near_anchor"), near).alias("anchor"), zone.alias("zone"), F.when(free, target).alias("target"),
    )


def label_match(a: Column, b: Column) -> Column:
    """Equal, or one inside the other if the shorter has four letters or more."""
    return (a == b) | ((F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) >= 4))


def spatial_bonus(relation: Column, version: int = 2) -> Column:
    """Bonus of a node for a relation to its anchor, from dx, dy, dz (node less anchor). Version 1 gives left and right a constant, as
    its distance term never counts; version 2 lets them fall off over five metres."""
    dx, dy, dz = F.col("dx"), F.col("dy"), F.col("dz")
    flat, far = F.sqrt(dx * dx + dy * dy), F.sqrt(dx * dx + dy * dy + dz * dz)
    rise = lambda z: F.greatest(F.lit(0.0), F.least(F.lit(0.22), 0.05 * z))
    side = lambda d: F.when(d <= 0, 0.0).otherwise(0.14 if version == 1 else 0.5 * F.greatest(F.lit(0.0), 1.0 - d / 5.0))
    depth = lambda d: F.when(d > 0, F.greatest(F.lit(0.0), 0.14 - 0.05 * d))
    return F.coalesce(
        F.when(relation == "BELOW", rise(-dz) + F.greatest(F.lit(0.0), 0.16 - 0.04 * flat)).when(relation == "ABOVE", rise(dz)).when(relation == "LEFT_OF", side(-dx)).when(relation == "RIGHT_OF", side(dx))
        .when(relation == "IN_FRONT_OF", depth(dy)).when(relation == "BEHIND", F.when(dy < 0, 0.14)).when(relation == "NEAR", F.greatest(F.lit(0.0), 0.2 - 0.055 * far)), F.lit(0.0),
    )


def salience(relation: Column) -> Column:
    """Nearness in the plane, for what is above or below."""
    flat = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return F.when(relation.isin("ABOVE", "BELOW"), F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - 0.38 * flat))).otherwise(1.0)


def score(parsed: DataFrame, ents: DataFrame, edges: DataFrame | None = None, version: int = 2) -> DataFrame:
    """question_id, intent, scene_id, uid, ordinal, score of every node that scores: ``edges`` (scene_id, type, src_uid, tgt_uid) are the
    nodes' relations in both directions (without them the sparse ones, of which only the types toward each class are made), nodes are
    named by their class. Equivalence is settled between the few distinct anchors and
    classes; nodes then meet questions by equal classes only."""
    classes = ents.select("class").distinct()
    asked = parsed.where("anchor is not null").select("anchor").distinct()
    like = F.broadcast(asked.join(classes, label_match(F.regexp_replace("anchor", "_", " "), F.regexp_replace("class", "_", " "))))  # a vocabulary's size
    if edges is None:
        named = pairwise.kinds(ents, ents.join(like.select("class").distinct(), "class", "left_semi"), "class").join(like, "class")
        toward = named.groupBy("scene_id", "anchor", "uid").agg(pairwise.types(F.bit_or("kinds")).alias("types"))
    else:
        ends = ents.select("scene_id", F.col("uid").alias("tgt_uid"), "class")
        toward = edges.join(ends, ["scene_id", "tgt_uid"]).join(like, "class").groupBy("scene_id", "anchor", F.col("src_uid").alias("uid")).agg(F.array_sort(F.collect_set("type")).alias("types"))
    toward = toward.withColumn("first_type", F.col("types")[0])
    anchors = ents.join(like, "class").groupBy("scene_id", "anchor").agg(F.min_by(F.struct("cx", "cy", "cz"), "ordinal").alias("b"))
    nodes = ents.select("scene_id", "uid", "ordinal", "class", "cx", "cy", "cz")
    spatial = (
        F.broadcast(parsed.where("intent = 'describe_spatial'")).join(toward, "anchor").where(F.expr("array_contains(types, relation)")).join(anchors, ["scene_id", "anchor"]).join(nodes, ["scene_id", "uid"])
        .withColumns({f"d{k}": F.col(f"c{k}") - F.col(f"b.c{k}") for k in "xyz"})
    )
    one = spatial.select("question_id", "intent", "scene_id", "uid", "ordinal", ((1.0 + spatial_bonus(F.col("relation"), version)) * salience(F.col("relation"))).alias("score"))
    free = F.broadcast(parsed.where("intent in ('find_location', 'describe', 'find_object', 'describe_near_anchor')"))
    by_label = free.where("target is not null").join(nodes, label_match_any(F.col("target"), F.col("class"))).select("question_id", "intent", "scene_id", "uid", "ordinal", F.lit(LABEL).alias("score"))
    by_anchor = free.where("anchor is not null").join(toward, "anchor").join(nodes.select("scene_id", "uid", "ordinal"), ["scene_id", "uid"]).select("question_id", "intent", "scene_id", "uid", "ordinal", F.when(F.col("first_type") == "NEAR", NEAR_ANCHOR).otherwise(OTHER_ANCHOR).alias("score"))
    two = by_label.unionByName(by_anchor).groupBy("question_id", "intent", "scene_id", "uid", "ordinal").agg(F.sum("score").alias("score"))
    return one.unionByName(two)


def label_match_any(a: Column, b: Column) -> Column:
    """Equal, or one inside the other, whatever their lengths."""
    return F.contains(a, b) | F.contains(b, a)


def best(scored: DataFrame, least: float = 0.20) -> DataFrame:
    """The intent's number of best nodes of at least ``least``; equal scores in the order of the scene."""
    k = F.coalesce(*[F.when(F.col("intent") == i, F.lit(n)) for i, n in K_OF.items()], F.lit(4))
    w = W.partitionBy("question_id", "scene_id").orderBy(F.col("score").desc(), "ordinal")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("intent")


def meets(node_zone: Column, node_label: Column, expected: Column) -> Column:
    """Whether a node is what was expected: its zone, its label, or one label inside the other from four letters on."""
    return (node_zone == expected) | (node_label == expected) | ((F.length(expected) >= 4) & label_match_any(expected, node_label))
