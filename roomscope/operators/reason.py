"""Questions in batches: ordered templates, binding over edges, honest outcomes, answer texts (Q1 to Q14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roomscope.operators import pairwise

# Templates in their order, nouns and texts that answers must carry.
_WHAT = r"^what(?:'s| is) "
_NOUN = r"(?:the )?(.+?)\??$"
TEMPLATES = [
    ("(?:to the )?left of ", "LEFT_OF"), ("(?:to the )?right of ", "RIGHT_OF"), ("(?:directly )?below ", "BELOW"), ("under ", "BELOW"), ("(?:directly )?above ", "ABOVE"),
    ("in front of ", "IN_FRONT_OF"), ("behind ", "BEHIND"), ("near ", "NEAR"), ("(?:close to|next to) ", "NEAR"),
]
ON_NOUNS = {"table": "table", "tabletop": "table", "desk": "desk", "chair": "chair", "seat": "chair", "stool": "stool", "bench": "bench", "shelf": "shelf", "sofa": "sofa", "plant stand": "plant-stand", "plant-stand": "plant-stand", "counter": "counter"}
ON_NOUNS_V2 = ON_NOUNS | {"cabinet": "cabinet", "nightstand": "nightstand", "bed": "bed"}
DEFERRED_ON = "this support class is not covered by EntitySurface in P6"
DEFERRED_AGAINST = "wall contact only supports 'against the wall' in P5; this surface is not a wall"
DEFERRED_ATTACHED = "ATTACHED_TO currently supports wall surfaces only"
TEXT_FAILURE = "I couldn't understand the question well enough to answer it."
TEXT_EMPTY = "Nothing in the scene matches that."
TEXT_UNKNOWN = "I don't have enough evidence to say. The underlying extractor's recall is below the threshold needed to treat a no-match result as a true negative."


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def compile_questions(questions: DataFrame, nouns: dict[str, str] | None = None, attached: bool = True, support: bool = True) -> DataFrame:
    """Adds outcome, edge_type, anchor_kind, anchor and reason to questions (text).

    Templates are tried in order: on, attached to, against, near the wall, then the plain relations. ``attached`` and ``support``
    off give the earlier vocabularies, which defer those questions.
    """
    # Each pattern is matched once, in a step of its own: rules that use its noun again would match it again.
    middles = ["on ", "attached to ", "against ", *(m for m, _ in TEMPLATES)]
    names = ON_NOUNS if nouns is None else nouns
    asked = questions.withColumn("_q", normalised(F.col("text"))).withColumns({f"_f{i}": F.regexp_extract("_q", _WHAT + m + _NOUN, 1) for i, m in enumerate(middles)})
    asked = asked.withColumns({f"_n{i}": F.when(F.col(f"_f{i}") != "", F.trim(F.regexp_replace(f"_f{i}", r"[.?!]+$", ""))) for i in range(len(middles))})

    def noun(middle: str) -> Column:
        return F.col(f"_n{middles.index(middle)}")

    text = lambda x: F.lit(x).cast("string")
    plan = lambda outcome, edge=None, kind=None, anchor=None, why=None: F.struct(
        text(outcome).alias("outcome"), text(edge).alias("edge_type"), text(kind).alias("anchor_kind"), (anchor if anchor is not None else text(None)).alias("anchor"), text(why).alias("reason")
    )
    on, att, against, near = noun("on "), noun("attached to "), noun("against "), noun("near ")
    classes = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = F.when(on == "floor", plan("compiled", "SUPPORTS", "surface", F.lit("floor")))
    if support:
        out = out.when(on.isin(*names), plan("compiled", "SUPPORTS", "class", classes[on]))
    out = out.when(on.isNotNull(), plan("out_of_schema", why=DEFERRED_ON))
    if attached:
        out = out.when(att == "wall", plan("compiled", "ATTACHED_TO", "surface", F.lit("wall")))
    out = out.when(att.isNotNull(), plan("out_of_schema", why=DEFERRED_ATTACHED))
    out = out.when(against == "wall", plan("compiled", "CONTACTS_SURFACE", "surface", F.lit("wall"))).when(against.isNotNull(), plan("out_of_schema", why=DEFERRED_AGAINST))
    out = out.when(near == "wall", plan("compiled", "NEAR_SURFACE", "surface", F.lit("wall")))
    for middle, edge in TEMPLATES:
        anchor = noun(middle)
        out = out.when(anchor.isNotNull() & (anchor != ""), plan("compiled", edge, "entity", anchor))
    # Exploded, the rules stand once in the query's plan; conditions on their fields would else repeat all of them.
    return asked.withColumn("plan", F.explode(F.array(out.otherwise(plan("parser_failure"))))).select(*questions.columns, "plan.*")


def bindings(compiled: DataFrame, ents: DataFrame, canonical: DataFrame, surface_edges: DataFrame, surfs: DataFrame, on_ent: DataFrame) -> DataFrame:
    """question_id, scene_id, uid, ordinal, edge_id: each entity bound once, by its first edge."""
    ask = compiled.where("outcome = 'compiled'").select("question_id", "scene_id", "edge_type", "anchor_kind", "anchor")
    label = F.regexp_replace(F.lower("label"), "_", " ")
    named = ents.select("scene_id", F.col("uid").alias("anchor_uid"), F.explode(F.array(F.lower("class"), label)).alias("anchor")).distinct()
    by_entity = ask.where("anchor_kind = 'entity'").join(named, ["scene_id", "anchor"]).join(canonical.select("scene_id", F.col("type").alias("edge_type"), F.col("src_uid").alias("uid"), F.col("tgt_uid").alias("anchor_uid"), "edge_id"), ["scene_id", "edge_type", "anchor_uid"])
    by_type = surface_edges.join(surfs.select("scene_id", F.col("suid").alias("tgt_uid"), F.col("stype").alias("anchor")), ["scene_id", "tgt_uid"]).select("scene_id", F.when(F.col("type") == "ON_SURFACE", "SUPPORTS").otherwise(F.col("type")).alias("edge_type"), "anchor", F.col("src_uid").alias("uid"), "edge_id")
    by_surface = ask.where("anchor_kind = 'surface'").join(by_type, ["scene_id", "edge_type", "anchor"])
    owners = on_ent.join(ents.select("scene_id", F.col("uid").alias("tgt_uid"), F.col("class").alias("anchor")), ["scene_id", "tgt_uid"]).select("scene_id", "anchor", F.col("src_uid").alias("uid"), "edge_id")
    by_class = ask.where("anchor_kind = 'class'").join(owners, ["scene_id", "anchor"])
    cols = ["question_id", "scene_id", "uid", "edge_id"]
    found = by_entity.select(*cols).unionByName(by_surface.select(*cols)).unionByName(by_class.select(*cols))
    first = found.groupBy("question_id", "scene_id", "uid").agg(F.min("edge_id").alias("edge_id"))
    return first.join(ents.select("scene_id", "uid", "ordinal", "label"), ["scene_id", "uid"])


def answering(compiled: DataFrame, ents: DataFrame, surface_edges: DataFrame, surfs: DataFrame, on_ent: DataFrame) -> DataFrame:
    """question_id, scene_id, uid: each entity that answers, once. Of the sparse edges between entities only their types toward what is
    asked for are made."""
    ask = compiled.where("outcome = 'compiled'").select("question_id", "scene_id", "edge_type", "anchor_kind", "anchor")
    label = F.regexp_replace(F.lower("label"), "_", " ")
    of_entity = ask.where("anchor_kind = 'entity'").withColumn("bit", F.create_map(*[F.lit(x) for k, n in enumerate(pairwise.KINDS) for x in (n, 1 << k)])[F.col("edge_type")])
    named = ents.withColumn("anchor", F.explode(F.array_distinct(F.array(F.lower("class"), label)))).join(of_entity.select("scene_id", "anchor").distinct(), ["scene_id", "anchor"], "left_semi")
    by_entity = of_entity.join(pairwise.kinds(ents, named, "anchor"), ["scene_id", "anchor"]).where("kinds & bit <> 0")
    by_type = surface_edges.join(surfs.select("scene_id", F.col("suid").alias("tgt_uid"), F.col("stype").alias("anchor")), ["scene_id", "tgt_uid"]).select("scene_id", F.when(F.col("type") == "ON_SURFACE", "SUPPORTS").otherwise(F.col("type")).alias("edge_type"), "anchor", F.col("src_uid").alias("uid"))
    by_surface = ask.where("anchor_kind = 'surface'").join(by_type, ["scene_id", "edge_type", "anchor"])
    owners = on_ent.join(ents.select("scene_id", F.col("uid").alias("tgt_uid"), F.col("class").alias("anchor")), ["scene_id", "tgt_uid"]).select("scene_id", "anchor", F.col("src_uid").alias("uid"))
    by_class = ask.where("anchor_kind = 'class'").join(owners, ["scene_id", "anchor"])
    cols = ["question_id", "scene_id", "uid"]
    return by_entity.select(*cols).unionByName(by_surface.select(*cols)).unionByName(by_class.select(*cols)).distinct()


def human_list(items: Column) -> Column:
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.concat(items[0], F.lit(" and "), items[1])).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def outcome(answered: Column, profile: Column | None = None) -> Column:
    """Outcome of a compiled question that some entity answers, or none. ``profile``: coverage floor of the scene's edges (1 for an
    oracle's), 0.95 or more makes a missing match an honest "empty", less makes it "unknown"."""
    floor = F.lit(1.0) if profile is None else profile
    return (
        F.when(F.col("outcome") == "parser_failure", "parser_failure").when(F.col("outcome") == "out_of_schema", "abstain")
        .when(answered, "bindings").when(floor >= 0.95, "empty").otherwise("unknown")
    )


def answers(compiled: DataFrame, bound: DataFrame, profile: Column | None = None) -> DataFrame:
    """Outcome and text of every question; ``bound`` has ordinal and label."""
    listed = bound.groupBy("question_id", "scene_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "uid", "label"))).alias("b"))
    joined = compiled.join(listed, ["question_id", "scene_id"], "left")
    labels = F.transform("b", lambda x: F.regexp_replace(x["label"], "_", " "))
    text = (
        F.when(F.col("answer") == "parser_failure", TEXT_FAILURE)
        .when(F.col("answer") == "abstain", F.concat(F.lit("I can't answer that yet — "), F.col("reason"), F.lit(". This isn't a claim that nothing is there.")))
        .when(F.col("answer") == "bindings", F.concat(F.lit("The "), human_list(labels), F.lit("."))).when(F.col("answer") == "empty", TEXT_EMPTY).otherwise(TEXT_UNKNOWN)
    )
    return joined.withColumn("answer", outcome(F.col("b").isNotNull(), profile)).select(
        "question_id", "scene_id", F.col("answer").alias("outcome"), text.alias("answer_text"),
        F.array_join(F.transform("b", lambda x: x["uid"]), ",").alias("cited_uids"), F.coalesce(F.size("b"), F.lit(0)).cast("int").alias("n_cited"),
    )


def first_citations(bound: DataFrame) -> DataFrame:
    """The first cited edge of each question."""
    w = W.partitionBy("question_id", "scene_id").orderBy("ordinal")
    return bound.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
