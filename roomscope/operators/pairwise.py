"""What is asked of a scene's pairs, without the pairs: a task meets a bounded block of sources with a bounded block of targets.

The number of pairs in reach grows with the square of a scene's density. Where only a count, a yes or no or a few of them are wanted,
the pairs are compared as arrays and only the answer leaves the task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomscope.operators.joins import dealt, split_cells

SOURCES, TARGETS, ROWS = 4096, 32768, 128
#: Directions from a source to a target and their bits; NEAR is the last.
KINDS = ("LEFT_OF", "RIGHT_OF", "BEHIND", "IN_FRONT_OF", "BELOW", "ABOVE", "NEAR")
POINT = ["cx", "cy", "cz"]


def in_blocks(sources: DataFrame, targets: DataFrame, reach: float | None, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over every block of sources with every block of targets that may be in reach of them (all of the scene's if None).

    Both need scene_id, ordinal, cx, cy, cz; a source meets a target in exactly one block. The result has scene_id first.
    """
    left, right, keys = split_cells(sources, targets, POINT, None if reach is None else {k: F.lit(reach) for k in POINT}, SOURCES, TARGETS)

    def both(key, one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({n.split()[0]: [] for n in schema.split(", ")})
        out = run(one, other.rename(columns=lambda c: c[1:]))
        out.insert(0, "scene_id", key[0])
        return out

    # Both may come from one table: the targets' columns get names of their own.
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns if c != "same"])
    named = [f"_{k}" for k in keys]
    return dealt(left, keys).groupBy(*keys).cogroup(dealt(right, named).groupBy(*named)).applyInPandas(both, schema)


def most(limit: float, inclusive: bool) -> float:
    """The greatest square whose root is at most (or below) a limit."""
    ok = (lambda x: np.sqrt(x) <= limit) if inclusive else (lambda x: np.sqrt(x) < limit)
    x = np.float64(limit) * limit
    while not ok(x):
        x = np.nextafter(x, -np.inf)
    while ok(np.nextafter(x, np.inf)):
        x = np.nextafter(x, np.inf)
    return float(x)


def _points(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[POINT].to_numpy(dtype="float64", na_value=np.nan)


def _differences(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    dx, dy, dz = (s[:, k, None] - t[None, :, k] for k in range(3))
    return dx, dy, dz, dx * dx + dy * dy + dz * dz


def _directions(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray, least: float) -> np.ndarray:
    """The bit of each pair's direction along its dominant axis (ties go to x, then y), 0 if the difference is too small."""
    ax, ay, az = np.abs(dx), np.abs(dy), np.abs(dz)
    yz = np.maximum(ay, az)
    on_x, on_y = ax >= yz, ay >= az
    bit = np.where(on_x, np.where(dx < 0, np.uint8(1), np.uint8(2)), np.where(on_y, np.where(dy < 0, np.uint8(4), np.uint8(8)), np.where(dz < 0, np.uint8(16), np.uint8(32))))
    return np.where(np.maximum(ax, yz) >= least, bit, np.uint8(0))


def kinds(sources: DataFrame, targets: DataFrame, by: str, reach: float = 2.5, least: float = 0.5, near: float = 1.0, one_is_enough: bool = False) -> DataFrame:
    """scene_id, uid, ``by``, kinds: for each source and each group of targets (column ``by``) the types of edges (both directions of
    the sparse directional ones, NEAR) that lead to any of the group, as bits of KINDS. Sources that have found all the types they can
    have (or any, if ``one_is_enough``) are compared no further."""
    far, close = most(reach, True), most(near, False)

    def bits(s, so, t, to):
        dx, dy, dz, d2 = _differences(s, t)
        out = np.where(d2 <= far, _directions(dx, dy, dz, least), np.uint8(0))
        out |= ((d2 <= close) & (so[:, None] != to[None, :])).astype("uint8") << 6
        return np.bitwise_or.reduce(out, axis=1)

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        group, names = pd.factorize(other[by])
        order = np.argsort(group, kind="stable")
        t, to, group = _points(other)[order], other["ordinal"].to_numpy()[order], group[order]
        s, so, found = _points(one), one["ordinal"].to_numpy(), []
        for g, name in enumerate(names):
            a, b = np.searchsorted(group, [g, g + 1])
            low, high = t[a:b].min(axis=0), t[a:b].max(axis=0)
            able = np.zeros(len(s), "uint8")
            for k in range(3):
                able |= (s[:, k] <= high[k] - least * 0.999).astype("uint8") << (2 * k)
                able |= (s[:, k] >= low[k] + least * 0.999).astype("uint8") << (2 * k + 1)
            able |= ((s >= low - near) & (s <= high + near)).all(axis=1).astype("uint8") << 6
            got, left, at = np.zeros(len(s), "uint8"), np.flatnonzero(able), a
            while at < b and len(left):
                end = min(b, at + 512)
                for k in range(0, len(left), ROWS):
                    rows = left[k : k + ROWS]
                    got[rows] |= bits(s[rows], so[rows], t[at:end], to[at:end])
                left, at = left[got[left] == 0 if one_is_enough else (got[left] & able[left]) != able[left]], end
            hit = np.flatnonzero(got)
            found.append(pd.DataFrame({"uid": one["uid"].to_numpy()[hit], by: name, "kinds": got[hit].astype("int32")}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"uid": [], by: [], "kinds": []})

    clean = targets.where(" and ".join(f"{c} is not null" for c in POINT)).where(F.col(by).isNotNull())
    parts = in_blocks(sources.select("scene_id", "ordinal", "uid", *POINT), clean.select("scene_id", "ordinal", by, *POINT), reach, run, f"scene_id string, uid string, {by} string, kinds int")
    return parts.groupBy("scene_id", "uid", by).agg(F.bit_or("kinds").alias("kinds"))


def reached(ents: DataFrame, anchors: DataFrame, hops: int = 1) -> DataFrame:
    """Entities within so many sparse edges of any type and either direction of the anchors (rows of ``ents``), with the least number of
    hops; found step by step from the entities that aren't reached yet."""
    seen = anchors.select("scene_id", "uid").distinct().withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        last = ents.join(seen.where(F.col("hops") == k - 1), ["scene_id", "uid"], "left_semi").withColumn("to", F.lit("any"))
        found = kinds(ents.join(seen, ["scene_id", "uid"], "left_anti"), last, "to", one_is_enough=True)
        seen = seen.unionByName(found.select("scene_id", "uid", F.lit(k).alias("hops")))
    return seen


def near_links(ents: DataFrame, radius: float) -> DataFrame:
    """scene_id, src_uid, tgt_uid: near pairs that connect what all near pairs connect. Each block gives a spanning forest of its own: as
    many links as it has entities at most, whose components are those of its pairs."""
    close = most(radius, False)

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        s, so, t, to = _points(one), one["ordinal"].to_numpy(), _points(other), other["ordinal"].to_numpy()
        su, tu = one["uid"].to_numpy(), other["uid"].to_numpy()
        free, rows, cols = np.ones(len(t), bool), [], []
        seen = np.zeros(len(s), bool)
        for start in range(len(s)):
            queue = [] if seen[start] else [start]
            seen[start] = True
            while queue:
                i = queue.pop()
                d = t - s[i]
                at = np.flatnonzero(free & (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= close) & (to != so[i]))
                free[at] = False
                rows += [i] * len(at)
                cols += at.tolist()
                for j in at:  # sources that meet a target of this tree belong to it
                    left = np.flatnonzero(~seen)
                    if not len(left):
                        break
                    d = s[left] - t[j]
                    new = left[(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= close) & (so[left] != to[j])]
                    seen[new] = True
                    rows += new.tolist()
                    cols += [j] * len(new)
                    queue += new.tolist()
        return pd.DataFrame({"src_uid": su[rows], "tgt_uid": tu[cols]})

    e = ents.select("scene_id", "ordinal", "uid", *POINT).where(" and ".join(f"{c} is not null" for c in POINT))
    return in_blocks(e, e, radius, run, "scene_id string, src_uid string, tgt_uid string")


def types(kinds_column: Column) -> Column:
    """The names of the types whose bits are set, in their alphabetical order."""
    named = sorted((n, k) for k, n in enumerate(KINDS))
    return F.filter(F.array(*[F.when(kinds_column.bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for n, k in named]), lambda x: x.isNotNull())


def counts(ents: DataFrame, radii: list[float], reach: float | None = None, least: float = 0.5) -> DataFrame:
    """scene_id and, for each radius, the number n0, n1, ... of pairs closer than it; with ``reach`` also ``directed``, the number of sparse
    directional edges. Scenes without pairs in one block have no row."""
    limits, far = [most(r, False) for r in radii], most(reach, True) if reach else -1.0

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        s, so, t, to = _points(one), one["ordinal"].to_numpy(), _points(other), other["ordinal"].to_numpy()
        n = np.zeros(len(limits) + 1, "int64")
        for k in range(0, len(s), ROWS):
            for j in range(0, len(t), 1024):
                dx, dy, dz, d2 = _differences(s[k : k + ROWS], t[j : j + 1024])
                d2[so[k : k + ROWS, None] >= to[None, j : j + 1024]] = np.inf
                for i, x in enumerate(limits):
                    n[i] += np.count_nonzero(d2 <= x)
                if reach:
                    n[-1] += np.count_nonzero((d2 <= far) & (np.maximum(np.maximum(np.abs(dx), np.abs(dy)), np.abs(dz)) >= least))
        return pd.DataFrame([n], columns=names)

    names = [*(f"n{i}" for i in range(len(limits))), "directed"]
    e = ents.select("scene_id", "ordinal", *POINT)
    parts = in_blocks(e, e, max([*radii, reach or 0.0]), run, "scene_id string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("scene_id").agg(*[F.sum(n).alias(n) for n in names])


def first_relations(ents: DataFrame, most_of: int, reach: float = 2.5, least: float = 0.5, near: float = 1.0) -> DataFrame:
    """scene_id, uid, type, tgt_ordinal of each entity's first ``most_of`` stored edges (LEFT_OF, BEHIND, ABOVE, and NEAR to later
    entities) by type and target's ordinal."""
    far, close = most(reach, True), most(near, False)
    rank = np.full(256, 4, "int64")  # by bits: ABOVE, BEHIND, LEFT_OF
    rank[[32, 4, 1]] = [0, 1, 2]

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values("ordinal", kind="stable")
        s, so, t, to = _points(one), one["ordinal"].to_numpy(), _points(other), other["ordinal"].to_numpy()
        n, found = len(t), []
        for k in range(0, len(s), ROWS):
            best = np.full((min(ROWS, len(s) - k), most_of), 4 * n)
            open_ = np.arange(len(best))
            for j in range(0, n, 1024):
                rows, at = open_ + k, np.arange(j, min(n, j + 1024))
                dx, dy, dz, d2 = _differences(s[rows], t[at])
                key = rank[np.where(d2 <= far, _directions(dx, dy, dz, least), np.uint8(0))]
                key = np.where(key < 4, key * n + at, 4 * n)
                also = np.where((d2 <= close) & (so[rows, None] < to[None, at]), 3 * n + at, 4 * n)
                both = np.concatenate([best[open_], _smallest(key, most_of), _smallest(also, most_of)], axis=1)
                best[open_] = np.sort(both, axis=1)[:, :most_of]
                open_ = open_[best[open_, -1] >= n]  # eight of the first type, at the lowest ordinals, are final
                if not len(open_):
                    break
            row, col = np.nonzero(best < 4 * n)
            key = best[row, col]
            found.append(pd.DataFrame({"uid": one["uid"].to_numpy()[row + k], "rank": (key // n).astype("int32"), "tgt_ordinal": to[key % n]}))
        return pd.concat(found, ignore_index=True)

    e = ents.where(" and ".join(f"{c} is not null" for c in POINT))
    parts = in_blocks(e.select("scene_id", "ordinal", "uid", *POINT), e.select("scene_id", "ordinal", *POINT), reach, run, "scene_id string, uid string, rank int, tgt_ordinal long")
    names = F.array(*[F.lit(x) for x in ("ABOVE", "BEHIND", "LEFT_OF", "NEAR")])
    return parts.select("scene_id", "uid", names[F.col("rank")].alias("type"), "tgt_ordinal")


def _smallest(keys: np.ndarray, n: int) -> np.ndarray:
    return np.partition(keys, n - 1, axis=1)[:, :n] if keys.shape[1] > n else keys


def all_directions(ents: DataFrame, least: float = 0.3) -> DataFrame:
    """scene_id, type, n, least, greatest of all ordered pairs of a scene along their dominant axes: how many there are, and the least and
    the greatest of their joined uids. Every pair is looked at, as the count is of nearly all of them."""

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values("uid", kind="stable")
        s, so, su = _points(one), one["ordinal"].to_numpy(), one["uid"].to_numpy()
        t, to, tu = _points(other), other["ordinal"].to_numpy(), other["uid"].to_numpy()
        n, low, high = np.zeros(256, "int64"), {}, {}
        for k in range(0, len(s), ROWS):
            rows = slice(k, k + ROWS)
            first, last = np.full((6, len(s[rows])), -1), np.full((6, len(s[rows])), -1)
            for j in range(0, len(t), 1024):
                dx, dy, dz, _ = _differences(s[rows], t[j : j + 1024])
                bit = _directions(dx, dy, dz, least)
                bit[so[rows, None] == to[None, j : j + 1024]] = 0
                for b in range(6):
                    hit = bit == (1 << b)
                    n[1 << b] += np.count_nonzero(hit)
                    has = hit.any(axis=1)
                    new = has & (first[b] < 0)
                    first[b][new] = j + hit[new].argmax(axis=1)
                    last[b][has] = j + hit.shape[1] - 1 - hit[has][:, ::-1].argmax(axis=1)
            for b in range(6):
                for i in np.flatnonzero(first[b] >= 0):
                    x, y = su[k + i] + tu[first[b][i]], su[k + i] + tu[last[b][i]]
                    low[b], high[b] = min(x, low.get(b, x)), max(y, high.get(b, y))
        return pd.DataFrame({"type": [KINDS[b] for b in low], "n": [n[1 << b] for b in low], "least": list(low.values()), "greatest": [high[b] for b in low]})

    e = ents.select("scene_id", "ordinal", "uid", *POINT).where(" and ".join(f"{c} is not null" for c in POINT))
    parts = in_blocks(e, e, None, run, "scene_id string, type string, n long, least string, greatest string")
    return parts.groupBy("scene_id", "type").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
