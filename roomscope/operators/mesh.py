"""Mesh surfaces (A24, A25, I5, I14, I15): plane fits, adjacency, region growing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def face_geometry(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """scene_id, face_id, centre, area and unit normal of each triangle; faces without area have none and are left out."""
    corner = lambda n: vertices.select("scene_id", F.col("vertex_id").alias(f"v{n}"), F.struct("x", "y", "z").alias(f"p{n}"))
    t = triangles.join(corner(0), ["scene_id", "v0"]).join(corner(1), ["scene_id", "v1"]).join(corner(2), ["scene_id", "v2"])
    d = {(n, k): F.col(f"p{n}.{k}") - F.col(f"p0.{k}") for n in (1, 2) for k in "xyz"}
    cross = [d[1, "y"] * d[2, "z"] - d[1, "z"] * d[2, "y"], d[1, "z"] * d[2, "x"] - d[1, "x"] * d[2, "z"], d[1, "x"] * d[2, "y"] - d[1, "y"] * d[2, "x"]]
    size = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    out = t.withColumn("size", size).where("size > 0")
    centre = [((F.col(f"p0.{k}") + F.col(f"p1.{k}") + F.col(f"p2.{k}")) / 3).alias(f"c{k}") for k in "xyz"]
    return out.select("scene_id", "face_id", "v0", "v1", "v2", (F.col("size") / 2).alias("area"), *centre, *[(c / F.col("size")).alias(f"n{k}") for c, k in zip(cross, "xyz", strict=True)])


def face_adjacency(triangles: DataFrame) -> DataFrame:
    """Pairs of faces that share an edge which no third face has."""
    edges = triangles.select("scene_id", "face_id", F.explode(F.array(*[F.array(F.least(a, b), F.greatest(a, b)) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))])).alias("e"))
    return edges.groupBy("scene_id", "e").agg(F.min("face_id").alias("a"), F.max("face_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2 and a <> b").select("scene_id", "a", "b").distinct()


def plane_fits(faces: DataFrame, by: list[str]) -> DataFrame:
    """Area-weighted plane of each group of faces: sums in Spark, the smallest eigenvector of nine numbers in Python."""
    w = F.col("area")
    sums = [F.sum(w).alias("w"), *[F.sum(w * F.col(f"c{k}")).alias(k) for k in "xyz"], *[F.sum(w * F.col(f"c{a}") * F.col(f"c{b}")).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]]

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.array([r[k] for k in "xyz"]) / r["w"]
                c = np.array([[r["xx"], r["xy"], r["xz"]], [r["xy"], r["yy"], r["yz"]], [r["xz"], r["yz"], r["zz"]]]) / r["w"] - np.outer(m, m)
                val, vec = np.linalg.eigh(c)
                n = vec[:, 0] * (1 if vec[np.argmax(np.abs(vec[:, 0])), 0] > 0 else -1)
                rows.append({**{k: r[k] for k in by}, "a": n[0], "b": n[1], "c": n[2], "d": -float(n @ m), "rms": math.sqrt(max(0.0, val[0])), "area": r["w"]})
            yield pd.DataFrame(rows, columns=[*by, "a", "b", "c", "d", "rms", "area"])

    grouped = faces.groupBy(*by).agg(*sums)
    kinds = dict(grouped.dtypes)
    return grouped.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", a double, b double, c double, d double, rms double, area double")


def grow_regions(faces: DataFrame, adjacency: DataFrame, degrees: float = 8.0, residual: float = 0.02) -> DataFrame:
    """Regions of faces that agree with their seed's plane: seeds by area, then id; a face joins if its normal is within ``degrees``
    of the seed's and its centre within ``residual`` of the seed's plane. The order decides, so a scene is one task's work."""
    limit = math.cos(math.radians(degrees))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"scene_id": pd.Series(dtype=str), "face_id": pd.Series(dtype="int64"), "region": pd.Series(dtype="int64")})
        if left.empty:
            return out
        left = left.sort_values(["area", "face_id"], ascending=[False, True]).reset_index(drop=True)
        at = {f: i for i, f in enumerate(left["face_id"])}
        near: list[list[int]] = [[] for _ in range(len(left))]
        for a, b in zip(right["a"], right["b"], strict=True):
            if a in at and b in at:
                near[at[a]].append(at[b])
                near[at[b]].append(at[a])
        n, c = left[["nx", "ny", "nz"]].to_numpy(), left[["cx", "cy", "cz"]].to_numpy()
        region = np.full(len(left), -1)
        for seed in range(len(left)):
            if region[seed] >= 0:
                continue
            region[seed], queue = seed, [seed]
            while queue:
                for k in sorted(near[queue.pop(0)]):
                    if region[k] < 0 and abs(n[k] @ n[seed]) >= limit and abs((c[k] - c[seed]) @ n[seed]) <= residual:
                        region[k] = seed
                        queue.append(k)
        return pd.DataFrame({"scene_id": left["scene_id"], "face_id": left["face_id"], "region": left["face_id"].to_numpy()[region]})

    return faces.groupBy("scene_id").cogroup(adjacency.select(F.col("scene_id").alias("scene"), "a", "b").groupBy("scene")).applyInPandas(run, "scene_id string, face_id long, region long")
