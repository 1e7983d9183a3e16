"""Evaluation: set scores, confusion, sweeps, exclusive quantiles, log rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roomscope.operators import pairwise


def majority(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    """The object of most faces at each vertex, the smaller id of equals; -1 where no face touches it. ``corners`` has a row for each
    corner of a face (scene_id, vertex_id, object_id)."""
    n = corners.groupBy("scene_id", "vertex_id", "object_id").agg(F.count(F.lit(1)).alias("n"))
    won = n.groupBy("scene_id", "vertex_id").agg(F.min_by("object_id", F.struct((-F.col("n")).alias("n"), F.col("object_id").alias("o"))).alias("won"))
    return vertices.join(won, ["scene_id", "vertex_id"], "left").select("scene_id", "vertex_id", F.coalesce("won", F.lit(-1)).cast("long").alias("instance_id"))


def recall_at(iou: DataFrame, oracle_sizes: DataFrame, limits: list[float]) -> DataFrame:
    """Share of oracle instances with some prediction of at least each IoU; null without instances."""
    best = oracle_sizes.select("scene_id", "oracle").join(iou.groupBy("scene_id", "oracle").agg(F.max("iou").alias("best")), ["scene_id", "oracle"], "left")
    grid = F.explode(F.array(*[F.lit(float(x)) for x in limits]))
    return best.withColumn("limit", grid).groupBy("limit").agg(F.avg(F.when(F.col("best") >= F.col("limit"), 1.0).otherwise(0.0)).alias("recall"), F.count(F.lit(1)).alias("n"))


def segmentation_errors(over: DataFrame, pred_sizes: DataFrame, oracle_sizes: DataFrame, share: float = 0.1) -> DataFrame:
    """Oracle instances that two or more predictions each cover in part (split), and the other way round (merged)."""
    both = over.join(oracle_sizes, ["scene_id", "oracle"]).join(pred_sizes, ["scene_id", "pred"])
    split = both.where(F.col("overlap") >= share * F.col("oracle_size")).groupBy("scene_id", "oracle").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.count(F.lit(1)).alias("split"))
    merged = both.where(F.col("overlap") >= share * F.col("pred_size")).groupBy("scene_id", "pred").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").agg(F.count(F.lit(1)).alias("merged"))
    return split.crossJoin(merged)  # one row each


def failure_classes(oracle_sizes: DataFrame, resolved: DataFrame, raw: DataFrame, least: float = 0.5) -> DataFrame:
    """recovered, merged, lost_by_resolver or no_raw_proposal for each oracle instance, from IoUs before and after resolving."""
    best = lambda df, name: df.groupBy("scene_id", "oracle").agg(F.max("iou").alias(name), F.max(F.col("overlap")).alias(f"{name}_overlap"))
    both = oracle_sizes.join(best(resolved, "after"), ["scene_id", "oracle"], "left").join(best(raw, "before"), ["scene_id", "oracle"], "left")
    kind = (
        F.when(F.coalesce("after", F.lit(0.0)) >= least, "recovered").when(F.coalesce("after_overlap", F.lit(0)) >= 0.5 * F.col("oracle_size"), "merged")
        .when(F.coalesce("before", F.lit(0.0)) >= least, "lost_by_resolver").otherwise("no_raw_proposal")
    )
    return both.select("scene_id", "oracle", kind.alias("failure"))


def set_scores(df: DataFrame, cited: str, expected: str) -> DataFrame:
    """Hits and the 0/1-convention precision and recall of two id arrays."""
    sizes = {"hits": F.size(F.array_intersect(cited, expected)), "_p": F.size(cited), "_r": F.size(expected)}
    return count_scores(df.withColumns(sizes), "_p", "_r").drop("_p", "_r")


def count_scores(df: DataFrame, cited: str, expected: str) -> DataFrame:
    """The same of the numbers of ids: ``hits``, and how many are cited and expected."""
    hit, p, r = F.col("hits"), F.col(cited), F.col(expected)
    return df.withColumn("precision", F.when(p > 0, hit / p).when(r == 0, 1.0).otherwise(0.0)).withColumn("recall", F.when(r > 0, hit / r).otherwise(1.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def p95_exclusive(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The exclusive 95th percentile for 20 values or more, else the greatest value."""
    w = W.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    part = ranked.withColumn("_j", F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.expr("19 * (_n + 1) div 20")))).withColumn("_d", F.expr("19 * (_n + 1) - 20 * _j"))
    weight = F.when(F.col("_rank") == F.col("_j"), F.col(value) * (20 - F.col("_d"))).when(F.col("_rank") == F.col("_j") + 1, F.col(value) * F.col("_d"))
    return part.groupBy(*by).agg(F.when(F.max("_n") >= 20, F.sum(weight) / 20).otherwise(F.max(value)).alias("p95"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("greatest"))


def threshold_sweep(ents: DataFrame, base: float, factors: list[float]) -> DataFrame:
    """Near pairs added and lost when the radius is scaled. Those of a smaller radius are among those of a larger one, so their numbers
    are all that is needed, and one pass counts them."""
    n = pairwise.counts(ents, [base, *(base * f for f in factors)])
    total = n.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(factors) + 1)])
    more = lambda i, j: F.greatest(F.lit(0).cast("long"), F.col(f"n{i}") - F.col(f"n{j}"))
    rows = [F.struct(F.lit(float(f)).alias("factor"), more(i, 0).alias("added"), more(0, i).alias("lost")) for i, f in enumerate(factors, 1)]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def cosine_best(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The label of the nearest of a few centres (label, c) for each vector (vec_id, v); the smaller label of equals."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    cos = dot(F.col("v"), F.col("c")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("c"), F.col("c"))))
    # A label set is a fixed vocabulary: one row for each class.
    pairs = vectors.crossJoin(centres).withColumn("cos", cos)
    return pairs.groupBy("vec_id").agg(F.min_by(F.struct("label", "cos"), F.struct((-F.col("cos")).alias("s"), F.col("label").alias("l"))).alias("b")).select("vec_id", "b.label", "b.cos")


def benchmark_rollup(results: DataFrame) -> DataFrame:
    """Accuracies by category and in all (category null), from booleans top1, topk, met, and false_positives, latency."""
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(c)
    return results.rollup("category").agg(F.count(F.lit(1)).alias("n"), rate("top1"), rate("topk"), rate("met"), F.avg("false_positives").alias("mean_false_positives"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency"))


def outcome_counts(results: DataFrame, columns: list[str]) -> DataFrame:
    """How often each value of each column occurs, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in columns]))
    return results.select(pairs.alias("p")).groupBy("p.what", "p.value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, value: str, by: list[str], qs: list[float]) -> DataFrame:
    """Linear quantiles of a column by group."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile({value}, {q})").alias(f"q{int(q * 100)}") for q in qs])


def surface_metrics(cells: DataFrame) -> DataFrame:
    """Area-weighted coverage and spill by surface type and median plane errors, from (stype, area, coverage, spill, angle, offset)."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("area")) / F.nullif(F.sum("area"), F.lit(0.0))).alias(c)
    return cells.groupBy("stype").agg(weighted("coverage"), weighted("spill"), F.expr("percentile(angle, 0.5)").alias("median_angle"), F.expr("percentile(offset, 0.5)").alias("median_offset"))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The element at n div 2 in order (the upper one of an even number), and the greatest: by rank, no group is collected."""
    w = W.partitionBy(*by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_k") == F.expr("_n div 2 + 1"), F.col(value))).alias("median"), F.max(value).alias("greatest"), F.count(F.lit(1)).alias("n"))


def label_accuracy(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Top-1 and top-3 accuracy of ranked labels (array ``labels``) against ``truth``."""
    hit = lambda k: F.avg(F.when(F.array_contains(F.slice("labels", 1, k), F.col("truth")), 1.0).otherwise(0.0))
    return ranked.groupBy(*by).agg(hit(1).alias("top1"), hit(3).alias("top3"), F.count(F.lit(1)).alias("n"))


def rescored(one: DataFrame, other: DataFrame, flags: list[str]) -> DataFrame:
    """How many questions (question_id) change each flag between two scorings, and which way."""
    both = one.select("question_id", *flags).join(other.select("question_id", *[F.col(c).alias(f"_{c}") for c in flags]), "question_id")
    changes = F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("before"), F.col(f"_{c}").alias("after")) for c in flags]))
    return both.select(changes.alias("x")).select("x.*").groupBy("flag").agg(*[F.count(F.when(F.expr(e), 1)).alias(n) for n, e in (("gained", "not before and after"), ("lost", "before and not after"), ("same", "before = after"))])


def scene_aggregate(scores: DataFrame) -> DataFrame:
    """Micro precision and recall by kind of key: verified by people (the headline), or plausible only."""
    kind = F.when(F.col("verified"), "headline").otherwise("plausibility")
    return scores.groupBy(kind.alias("section")).agg(F.countDistinct("scene_id").alias("scenes"), F.count(F.lit(1)).alias("questions"), (F.sum("hits") / F.nullif(F.sum("cited"), F.lit(0))).alias("precision"), (F.sum("hits") / F.nullif(F.sum("expected"), F.lit(0))).alias("recall"))


def band_decision(rows: DataFrame) -> DataFrame:
    """Per band whether all surfaces are covered, close their loops and meet no impostor; and the verdict over all bands."""
    bands = rows.groupBy("band").agg(F.bool_and("coverage_ok").alias("viable"), F.bool_and("loop_ok").alias("loops"), F.sum("impostors").alias("impostors"))
    bands = bands.withColumn("clean", F.col("viable") & F.col("loops") & (F.col("impostors") == 0))
    verdict = bands.agg(F.when(F.bool_or("clean"), "CLEAN").when(F.bool_or(F.col("viable") & F.col("loops")), "MIXED").otherwise("OVERLAP").alias("verdict"))
    return bands.crossJoin(F.broadcast(verdict))  # one row
