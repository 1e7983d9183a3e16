"""PLY meshes as tables of vertices and triangles (IO9 to IO11), from any store Spark reads.

Files come whole through Spark's binaryFile reader; a file is one task's work, as a scan of a room is. ASCII and little-endian
binary files are understood; anything else, out-of-range corners and non-finite positions are errors. Polygons with four corners
split on the diagonal from the first to the third, in general into a fan from the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Scalar type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def header(data: bytes) -> tuple[bool, list[tuple[str, int, list[tuple[str, ...]]]], int]:
    """(binary, elements as (name, count, properties), offset of the body)."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    body = data.index(b"\n", end) + 1
    kind, elements = None, []
    for line in data[:end].decode("ascii").splitlines()[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            elements[-1][2].append(tuple(words[1:]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unsupported PLY format {kind}")
    return kind != "ascii", elements, body


def _rows(data: bytes, at: int, count: int, props: list[tuple[str, ...]], binary: bool) -> tuple[dict[str, object], int]:
    """Columns of one element: arrays of scalars, and for lists a list of arrays."""
    lists = [p for p in props if p[0] == "list"]
    if binary and not lists:
        kind = np.dtype([(p[1], "<" + TYPES[p[0]]) for p in props])
        block = np.frombuffer(data, dtype=kind, count=count, offset=at)
        return {n: block[n] for n in kind.names}, at + count * kind.itemsize
    if binary:
        # One shape for all rows is read at once; mixed ones row by row.
        sizes = np.frombuffer(data, dtype="<" + TYPES[lists[0][1]], count=1, offset=at + sum(np.dtype(TYPES[p[0]]).itemsize for p in props[: props.index(lists[0])])) if count and len(lists) == 1 else []
        if len(sizes):
            k = int(sizes[0])
            fields = [(p[1], "<" + TYPES[p[0]]) if p[0] != "list" else None for p in props]
            kind = np.dtype([x for f, p in zip(fields, props, strict=True) for x in ([f] if f else [("_n", "<" + TYPES[p[1]]), (p[3], "<" + TYPES[p[2]], (k,))])])
            if at + count * kind.itemsize <= len(data):
                block = np.frombuffer(data, dtype=kind, count=count, offset=at)
                if (block["_n"] == k).all():
                    return {n: (list(block[n]) if n == lists[0][3] else block[n]) for n in kind.names if n != "_n"}, at + count * kind.itemsize
        out: dict[str, list] = {p[-1]: [] for p in props}
        for _ in range(count):
            for p in props:
                n, item = 1, TYPES[p[0]] if p[0] != "list" else TYPES[p[2]]
                if p[0] == "list":
                    n = int(np.frombuffer(data, dtype="<" + TYPES[p[1]], count=1, offset=at)[0])
                    at += np.dtype(TYPES[p[1]]).itemsize
                got = np.frombuffer(data, dtype="<" + item, count=n, offset=at)
                at += got.nbytes
                out[p[-1]].append(got if p[0] == "list" else got[0])
        return {k: (v if any(p[-1] == k and p[0] == "list" for p in props) else np.array(v)) for k, v in out.items()}, at
    out = {p[-1]: [] for p in props}
    for _ in range(count):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        words, w = data[at:stop].split(), 0
        at = stop + 1
        for p in props:
            n = int(words[w]) if p[0] == "list" else 1
            w += p[0] == "list"
            got = [float(x) for x in words[w : w + n]]
            if len(got) < n:
                raise ValueError("short PLY row")
            w += n
            out[p[-1]].append(np.array(got) if p[0] == "list" else got[0])
    return {k: (v if any(p[-1] == k and p[0] == "list" for p in props) else np.array(v)) for k, v in out.items()}, at


def parse(data: bytes) -> dict[str, dict[str, object]]:
    binary, elements, at = header(data)
    out = {}
    for name, count, props in elements:
        out[name], at = _rows(data, at, count, props, binary)
        if at > len(data) + 1:
            raise ValueError("truncated PLY file")
    return out


def vertices(spark: SparkSession, path: str) -> DataFrame:
    """path, vertex_id, x, y, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = parse(data)["vertex"]
                xyz = [np.asarray(v[k], dtype=np.float64) for k in "xyz"]
                if not all(np.isfinite(c).all() for c in xyz):
                    raise ValueError(f"{name}: a position isn't finite")
                n = len(xyz[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), *map(pa.array, xyz)], names=["path", "vertex_id", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, vertex_id long, x double, y double, z double")


def triangles(spark: SparkSession, path: str) -> DataFrame:
    """path, face_id (of the polygon), v0, v1, v2, and object_id where faces carry one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mesh = parse(data)
                f = mesh.get("face", {})
                corners = f.get("vertex_indices", f.get("vertex_index", []))
                top = len(mesh["vertex"]["x"])
                rows = [(i, int(c[0]), int(c[k]), int(c[k + 1])) for i, c in enumerate(corners) for k in range(1, len(c) - 1)]
                if any(not 0 <= x < top for r in rows for x in r[1:]):
                    raise ValueError(f"{name}: a face has a corner out of range")
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                objects = pa.array([int(f["object_id"][i]) for i in cols[0]], pa.int64()) if "object_id" in f else pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols), objects], names=["path", "face_id", "v0", "v1", "v2", "object_id"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, face_id long, v0 long, v1 long, v2 long, object_id long")
