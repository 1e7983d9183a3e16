"""Instance masks: resolving, policies, repair, matching, evaluation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MV = ["scene_id", "vertex_id"]


def resolve(masks: DataFrame, mv: DataFrame, min_score: float = 0.0, min_vertices: int = 1) -> DataFrame:
    """Each vertex goes to its highest-scoring mask (lowest id of equals); winners left with too few vertices lose them all."""
    won = mv.join(masks.where(F.col("score") >= min_score), ["scene_id", "mask_id"]).groupBy(*MV).agg(F.min_by("mask_id", F.struct((-F.col("score")).alias("s"), F.col("mask_id").alias("m"))).alias("mask_id"))
    large = won.groupBy("scene_id", "mask_id").count().where(F.col("count") >= min_vertices)
    return won.join(large, ["scene_id", "mask_id"], "left_semi").select("scene_id", "vertex_id", F.col("mask_id").alias("instance_id"))


def resolve_sweep(masks: DataFrame, mv: DataFrame, scores: list[float], min_vertices: int) -> DataFrame:
    """Claimed vertices and instances at each least score, in one pass over a small grid."""
    spark = masks.sparkSession
    grid = spark.createDataFrame([(float(x),) for x in scores], "min_score double")
    own = mv.join(masks, ["scene_id", "mask_id"]).join(F.broadcast(grid), F.col("score") >= F.col("min_score"))
    won = own.groupBy("min_score", *MV).agg(F.min_by("mask_id", F.struct((-F.col("score")).alias("s"), F.col("mask_id").alias("m"))).alias("mask_id"))
    size = won.groupBy("min_score", "scene_id", "mask_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_vertices)
    return size.groupBy("min_score").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("claimed"))


def state(score: Column, accept: float = 0.2, keep: float = 0.05) -> Column:
    return F.when(score >= accept, "accepted").when(score >= keep, "provisional").otherwise("discarded")


def stable_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def evidence_mass(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Beta-style mass of observations (score, weight)."""
    pos, neg = F.sum(F.col("score") * F.col("weight")), F.sum((1 - F.col("score")) * F.col("weight"))
    return observed.groupBy(*keys).agg(pos.alias("positive"), neg.alias("negative"), F.count(F.lit(1)).alias("n")).withColumn("mean", F.col("positive") / (F.col("positive") + F.col("negative")))


def overlaps(one: DataFrame, other: DataFrame) -> DataFrame:
    """Shared vertices of instances of two assignments (instance_id each)."""
    return one.withColumnRenamed("instance_id", "pred").join(other.withColumnRenamed("instance_id", "oracle"), MV).where("pred >= 0 and oracle >= 0").groupBy("scene_id", "pred", "oracle").agg(F.count(F.lit(1)).alias("overlap"))


def sizes(a: DataFrame, name: str) -> DataFrame:
    return a.where("instance_id >= 0").groupBy("scene_id", F.col("instance_id").alias(name)).agg(F.count(F.lit(1)).alias(f"{name}_size"))


def with_iou(over: DataFrame, pred: DataFrame, oracle: DataFrame) -> DataFrame:
    both = over.join(sizes(pred, "pred"), ["scene_id", "pred"]).join(sizes(oracle, "oracle"), ["scene_id", "oracle"])
    return both.withColumn("iou", F.col("overlap") / (F.col("pred_size") + F.col("oracle_size") - F.col("overlap")))


def parts_for(df: DataFrame, rows: int, each: int = 300_000) -> int:
    """Partitions for so many rows of input, so that a task's memory doesn't grow with them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def mask_intersections(mv: DataFrame) -> DataFrame:
    """Shared vertices of every two masks of a scene that share any; a vertex brings as many pairs as it has masks.

    A vertex's masks go to the task of each of them as the list of those with higher ids, and are counted there; the pairs as such are
    never dealt, and the number of tasks follows the number of rows.
    """
    parts = parts_for(mv, mv.count())
    lists = mv.select(*MV, "mask_id").repartition(parts, *MV).groupBy(*MV).agg(F.array_sort(F.collect_list("mask_id")).alias("m"))
    at = lists.select("scene_id", "m", F.posexplode("m").alias("k", "a")).where("k < size(m) - 1").select("scene_id", "a", F.expr("slice(m, k + 2, size(m) - k - 1)").alias("later"))
    pairs = at.repartition(parts, "scene_id", "a").select("scene_id", "a", F.explode("later").alias("b")).where("a < b")
    return pairs.groupBy("scene_id", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


def mask_iou(mv: DataFrame) -> DataFrame:
    n = mv.groupBy("scene_id", "mask_id").agg(F.count(F.lit(1)).alias("n"))
    both = mask_intersections(mv).join(n.select("scene_id", F.col("mask_id").alias("a"), F.col("n").alias("na")), ["scene_id", "a"]).join(n.select("scene_id", F.col("mask_id").alias("b"), F.col("n").alias("nb")), ["scene_id", "b"])
    return both.select("scene_id", "a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("iou"))


def vertex_pairs(corners: DataFrame) -> DataFrame:
    """face, a, b (a < b) of the different vertices of each face, from (face, v): a face's vertices meet in its row, nothing is joined."""
    of = corners.select("face", "v").repartition(parts_for(corners, corners.count()), "face").groupBy("face").agg(F.array_sort(F.collect_set("v")).alias("m"))
    at = of.select("face", "m", F.posexplode("m").alias("k", "a")).where("k < size(m) - 1")
    return at.select("face", "a", F.explode(F.expr("slice(m, k + 2, size(m) - k - 1)")).alias("b"))


def edge_confidence(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Of each edge (a, b), the views in which both ends are visible, those of them in which they share a mask, and their ratio (0 if
    never both visible). ``seen``: view w, vertex v, mask (null where it is visible outside all masks)."""
    at = seen.groupBy("w", "v").agg(F.collect_set("mask").alias("masks"))
    one, other = at.select(F.col("v").alias("a"), "w", F.col("masks").alias("m1")), at.select(F.col("v").alias("b"), "w", F.col("masks").alias("m2"))
    both = edges.select("a", "b").distinct().join(one, "a", "left").join(other, ["b", "w"], "left")
    co = both.groupBy("a", "b").agg(F.count("m2").alias("co_vis"), F.count(F.when(F.arrays_overlap("m1", "m2"), 1)).alias("co_mem"))
    return co.withColumn("conf", F.when(F.col("co_vis") > 0, F.col("co_mem") / F.col("co_vis")).otherwise(0.0))


def greedy_match(over: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Greedy one-to-one matching by (-overlap, pred, oracle): in each round all pairs that are first for both their ends are taken.

    For a strict order of pairs this equals taking them one after the other. Each round is checkpointed. Ties and falling chains may
    free one pair a round, so what is left after ``most_rounds`` is taken one after the other, a scene's rest in one task.
    """
    from pyspark.sql import Window as W

    order = [F.col("overlap").desc(), "pred", "oracle"]
    rest, taken = over.select("scene_id", "pred", "oracle", "overlap"), None
    for _ in range(most_rounds):
        ranked = rest.withColumn("r1", F.row_number().over(W.partitionBy("scene_id", "pred").orderBy(*order))).withColumn("r2", F.row_number().over(W.partitionBy("scene_id", "oracle").orderBy(*order)))
        now = _settle(ranked.where("r1 = 1 and r2 = 1").drop("r1", "r2"))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        rest = _settle(rest.join(now.select("scene_id", "pred"), ["scene_id", "pred"], "left_anti").join(now.select("scene_id", "oracle"), ["scene_id", "oracle"], "left_anti"))
    else:
        now = _settle(rest.groupBy("scene_id").applyInPandas(_one_by_one, rest.schema))
        taken = now if taken is None else taken.unionByName(now)
    return taken if taken is not None else over.select("scene_id", "pred", "oracle", "overlap").limit(0)


def _one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """A scene's pairs by (-overlap, pred, oracle), each taken if both its ends are free."""
    pdf = pdf.sort_values(["overlap", "pred", "oracle"], ascending=[False, True, True])
    left, right, keep = set(), set(), []
    for i, j in zip(pdf["pred"], pdf["oracle"], strict=True):
        keep.append(i not in left and j not in right)
        if keep[-1]:
            left.add(i)
            right.add(j)
    return pdf[keep]


def _settle(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roomscope-checkpoint-"))
    return df.checkpoint(eager=True)


def repair_v1(masks: DataFrame, mv: DataFrame, contained: float = 0.8, smaller: float = 0.5, disjoint: float = 0.2, cover: float = 0.5, base: float = 0.2) -> DataFrame:
    """Merge decomposition: a mask that two or more smaller, nearly disjoint masks inside it cover gives way to them; they get its
    score if it is higher. Only masks with a score of ``base`` give way; lower ones are excluded unless they are such children. A parent
    that is another one's child stays. mask_id, score, and what became of it (kept, parent, child, excluded)."""
    n = mv.groupBy("scene_id", "mask_id").agg(F.count(F.lit(1)).alias("n"))
    size = lambda name: n.select("scene_id", F.col("mask_id").alias(name), F.col("n").alias(f"n{name}"))
    # The intersections are made once; only those that matter below are kept, in both directions.
    inter = mask_intersections(mv).join(size("a"), ["scene_id", "a"]).join(size("b"), ["scene_id", "b"])
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    inter = _settle(inter.where((F.col("shared") > disjoint * least) | (F.col("shared") >= contained * F.least(least, most))))
    both = inter.unionByName(inter.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b"), "shared", F.col("nb").alias("na"), F.col("na").alias("nb")))
    inside = both.where((F.col("shared") >= contained * F.col("nb")) & (F.col("nb") <= smaller * F.col("na"))).select("scene_id", F.col("a").alias("parent"), F.col("b").alias("child"), "shared", F.col("na").alias("np"), F.col("nb").alias("nc"))
    pairs = both.select("scene_id", F.col("a").alias("child"), F.col("b").alias("other"), (F.col("shared") / F.least("na", "nb")).alias("part")).where(F.col("part") > disjoint)
    # A child is out if a larger child of the same parent (or an equal one of smaller id) overlaps it too much and is itself in.
    clash = inside.alias("i").join(pairs, ["scene_id", "child"]).join(inside.select("scene_id", "parent", F.col("child").alias("other"), F.col("nc").alias("no")), ["scene_id", "parent", "other"]).where("no > nc or (no = nc and other < child)")
    clashes = clash.groupBy("scene_id", "parent", "child").agg(F.collect_set("other").alias("before"))
    ranked = inside.join(clashes, ["scene_id", "parent", "child"], "left").groupBy("scene_id", "parent", "np").agg(F.array_sort(F.collect_list(F.struct((-F.col("nc")).alias("k"), "child", "shared", F.coalesce("before", F.array().cast("array<bigint>")).alias("before")))).alias("all"))
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("long").alias("covered"))
    kept = F.aggregate("all", start, lambda acc, x: F.when(F.arrays_overlap(acc["ids"], x["before"]), acc).otherwise(F.struct(F.concat(acc["ids"], F.array(x["child"])).alias("ids"), (acc["covered"] + x["shared"]).alias("covered"))))
    able = masks.where(F.col("score") >= base).select("scene_id", F.col("mask_id").alias("parent"))
    split = ranked.join(able, ["scene_id", "parent"], "left_semi").withColumn("kept", kept).where((F.size("kept.ids") >= 2) & (F.col("kept.covered") >= cover * F.col("np")))
    up = split.join(masks.select("scene_id", F.col("mask_id").alias("parent"), F.col("score").alias("ps")), ["scene_id", "parent"]).select("scene_id", F.explode("kept.ids").alias("mask_id"), "ps").groupBy("scene_id", "mask_id").agg(F.max("ps").alias("ps"))
    parents = split.select("scene_id", F.col("parent").alias("mask_id")).distinct().withColumn("gone", F.lit(True))
    out = masks.join(up, ["scene_id", "mask_id"], "left").join(parents, ["scene_id", "mask_id"], "left")
    return out.select("scene_id", "mask_id", F.greatest("score", F.coalesce("ps", "score")).alias("score"), F.when(F.col("ps").isNotNull(), "child").when(F.col("gone"), "parent").when(F.col("score") < base, "excluded").otherwise("kept").alias("became"))


def repair_v2(masks: DataFrame, mv: DataFrame, contained: float = 0.8, smaller: float = 0.6, repeated: float = 0.7, retention: float = 0.5, base: float = 0.2, min_vertices: int = 20) -> DataFrame:
    """Corroborated carve-out. Masks of at least ``base`` take part by their score. A mask of any score that another one repeats (IoU of
    ``repeated``) and that lies inside a smaller-than-``smaller`` share of such a mask is put just above the best of these parents, so
    that it is carved out of them. Resolved once; masks that keep less than ``retention`` of their vertices are left out of a second
    and last resolving."""
    n = mv.groupBy("scene_id", "mask_id").agg(F.count(F.lit(1)).alias("n"))
    # Made once; pairs that neither repeat nor hold each other don't matter below.
    size = lambda name: n.select("scene_id", F.col("mask_id").alias(name), F.col("n").alias(f"n{name}"))
    pairs = mask_iou(mv).join(size("a"), ["scene_id", "a"]).join(size("b"), ["scene_id", "b"])
    pairs = _settle(pairs.where((F.col("iou") >= repeated) | (F.col("shared") >= contained * F.least("na", "nb"))).drop("na", "nb"))
    both = pairs.unionByName(pairs.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b"), "shared", "iou"))
    backed = both.where(F.col("iou") >= repeated).select("scene_id", F.col("b").alias("child")).distinct()
    parents = masks.where(F.col("score") >= base).join(n, ["scene_id", "mask_id"]).select("scene_id", F.col("mask_id").alias("a"), F.col("score").alias("parent_score"), F.col("n").alias("parent_n"))
    children = n.where(F.col("n") >= min_vertices).withColumnRenamed("mask_id", "child").join(backed, ["scene_id", "child"], "left_semi")
    inside = both.withColumnRenamed("b", "child").join(children, ["scene_id", "child"]).join(parents, ["scene_id", "a"]).where((F.col("shared") >= contained * F.col("n")) & (F.col("n") <= smaller * F.col("parent_n")))
    up = inside.groupBy("scene_id", F.col("child").alias("mask_id")).agg((F.max("parent_score") + 1e-6).alias("up"))
    ranked = masks.join(up, ["scene_id", "mask_id"], "left").select("scene_id", "mask_id", F.greatest(F.when(F.col("score") >= base, F.col("score")), F.col("up")).alias("score")).where("score is not null")
    first = resolve(ranked, mv, min_vertices=min_vertices).groupBy("scene_id", F.col("instance_id").alias("mask_id")).agg(F.count(F.lit(1)).alias("kept"))
    stay = first.join(n, ["scene_id", "mask_id"]).where(F.col("kept") >= retention * F.col("n")).select("scene_id", "mask_id")
    return resolve(ranked.join(stay, ["scene_id", "mask_id"], "left_semi"), mv, min_vertices=min_vertices)


def scoped_assignment(hard: DataFrame, mv: DataFrame, masks: DataFrame, selected: Column, protected: Column) -> DataFrame:
    """Selected masks by (-score, id) take over vertices, but not those of protected instances."""
    new = mv.join(masks.where(selected), ["scene_id", "mask_id"]).groupBy(*MV).agg(F.min_by("mask_id", F.struct((-F.col("score")).alias("s"), F.col("mask_id").alias("m"))).alias("new_id"))
    both = hard.join(new, MV, "full")
    return both.select("scene_id", "vertex_id", F.when(protected, F.col("instance_id")).otherwise(F.coalesce("new_id", "instance_id")).alias("instance_id"))


def joint_nomination(iou: DataFrame, least: float = 0.5) -> DataFrame:
    """Entities in order of their best IoU (then id) take their best mask not taken yet, higher ids first among equals.

    Sequential by definition: a scene's candidate pairs of at least ``least`` (a few for each entity) go to one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        best = pdf.groupby("oracle")["iou"].max()
        for o in sorted(best.index, key=lambda k: (-best[k], k)):
            own = pdf[pdf["oracle"] == o]
            for i, m in sorted(zip(own["iou"], own["pred"], strict=True), reverse=True):
                if m not in taken:
                    taken.add(m)
                    out.append((pdf["scene_id"].iloc[0], int(o), int(m), float(i)))
                    break
        return pd.DataFrame(out, columns=["scene_id", "oracle", "pred", "iou"])

    return iou.where(F.col("iou") >= least).groupBy("scene_id").applyInPandas(run, "scene_id string, oracle long, pred long, iou double")


def union_curve(mv: DataFrame, oracle: DataFrame, most: int = 8, candidates: int = 64) -> DataFrame:
    """For each oracle instance, masks added one by one as long as the union's IoU grows: instance, step, mask, IoU.

    The caps (64 candidates by overlap, 8 steps) are the definition.
    """
    from pyspark.sql import Window as W

    # The candidates are found by their numbers; only theirs of the vertices are gathered.
    w = W.partitionBy("scene_id", "instance_id").orderBy(F.col("n").desc(), "mask_id")
    hit = mv.join(oracle, MV).groupBy("scene_id", "instance_id", "mask_id").agg(F.count(F.lit(1)).alias("n"))
    first = hit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= candidates).drop("k")
    goal = oracle.groupBy("scene_id", "instance_id").agg(F.count(F.lit(1)).alias("goal"))
    own = mv.join(first, ["scene_id", "mask_id"]).join(oracle.withColumnRenamed("instance_id", "of"), MV, "left")
    joined = own.groupBy("scene_id", "instance_id", "mask_id", "n").agg(F.collect_set("vertex_id").alias("all"), F.collect_set(F.when(F.col("of") == F.col("instance_id"), F.col("vertex_id"))).alias("inside")).join(goal, ["scene_id", "instance_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "mask_id"], ascending=[False, True]).head(candidates)
        goal, inside, whole, now, out = int(pdf["goal"].iloc[0]), set(), set(), 0.0, []
        left = {int(m): (set(i), set(a)) for m, i, a in zip(pdf["mask_id"], pdf["inside"], pdf["all"], strict=True)}
        for step in range(1, most + 1):
            score = {m: len(inside | i) / (len(whole | a) + goal - len(inside | i)) for m, (i, a) in left.items()}
            if not score or max(score.values()) <= now:
                break
            m = min(score, key=lambda k: (-score[k], k))
            now = score[m]
            i, a = left.pop(m)
            inside |= i
            whole |= a
            out.append((pdf["scene_id"].iloc[0], int(pdf["instance_id"].iloc[0]), step, m, now))
        return pd.DataFrame(out, columns=["scene_id", "instance_id", "step", "mask_id", "iou"])

    return joined.groupBy("scene_id", "instance_id").applyInPandas(run, "scene_id string, instance_id long, step int, mask_id long, iou double")


def min_labels(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components (node, component): the smallest label travels along edges (a, b) until nothing changes."""
    both = _settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = _settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    mark = None
    for _ in range(most_rounds):
        seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        step = now.join(seen, "node").select("node", F.least("label", "other").alias("label"))
        jump = step.join(now.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        now = _settle(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        was, mark = mark, now.agg(F.sum("label"), F.count(F.lit(1))).first()
        if was == mark:
            return now.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def zbuffer(points: DataFrame, width: int = 64) -> DataFrame:
    """The nearest point of each pixel: points (view, vertex_id, px, py, depth) are splat 3 by 3, later ids win ties."""
    splat = points.withColumn("dx", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("dy", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    at = splat.select("view", (F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py"), "vertex_id", "depth").where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < width) & (F.col("py") < width))
    return at.groupBy("view", "px", "py").agg(F.min_by("vertex_id", F.struct(F.col("depth"), (-F.col("vertex_id")).alias("v"))).alias("vertex_id"))




#: Classes that are structure or no object.
STRUCTURAL_OR_DROPPED = ("floor", "wall", "ceiling", "undefined", "non-plane", "plane")


def inject_labels(ents: DataFrame, matches: DataFrame) -> DataFrame:
    """Entities (scene_id, uid, pred) with the class of their match (scene_id, pred, oracle_class): labelled, left anonymous without one,
    or removed where the class is structure or no object."""
    both = ents.join(matches.select("scene_id", "pred", "oracle_class"), ["scene_id", "pred"], "left")
    known = F.coalesce(F.col("oracle_class"), F.lit("")) != ""
    what = F.when(~known, "anonymous").when(F.col("oracle_class").isin(*STRUCTURAL_OR_DROPPED), "removed").otherwise("labelled")
    return both.withColumn("became", what).withColumn("label", F.when(F.col("became") == "labelled", F.col("oracle_class")))


def activated(checks: DataFrame) -> DataFrame:
    """Candidates (scene_id, candidate) with their checks against anchors (anchor_ordinal, ok, failed): selected if any anchor takes them;
    the checks stay, in the order of the anchors."""
    listed = F.array_sort(F.collect_list(F.struct("anchor_ordinal", "ok", "failed")))
    return checks.groupBy("scene_id", "candidate").agg(F.bool_or("ok").alias("selected"), listed.alias("checks"))


def unpacked(rows: DataFrame, bits: str = "bits", width: int = 64) -> DataFrame:
    """Packed mask rows (scene_id, mask_id, word, bits: 64 of them, the lowest first) as one row for each set bit."""
    at = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    return rows.withColumn("at", at).where(F.expr(f"getbit({bits}, at) = 1")).select("scene_id", "mask_id", (F.col("word") * width + F.col("at")).alias("vertex_id"))


def instance_table(assigned: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of each instance and their share of the scene's."""
    n = assigned.groupBy("scene_id", "instance_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(vertices.groupBy("scene_id").agg(F.count(F.lit(1)).alias("of")), "scene_id").select("scene_id", "instance_id", "n", (F.col("n") / F.col("of")).alias("share"))


def pooled(*banks: DataFrame) -> DataFrame:
    """Proposals of several banks as one, each with its bank's number."""
    out = None
    for k, b in enumerate(banks):
        b = b.withColumn("bank", F.lit(k))
        out = b if out is None else out.unionByName(b)
    return out
