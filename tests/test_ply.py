import struct

import pytest

from roomscope.sources import ply

ASCII = b"ply\nformat ascii 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0.5\n4 0 1 2 3\n3 0 1 2\n"


def binary(mixed: bool) -> bytes:
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nproperty ushort object_id\nend_header\n"
    body = b"".join(struct.pack("<3f", *v) for v in [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0.5)])
    faces = [(0, 1, 2, 3), (0, 1, 2) if mixed else (3, 2, 1, 0)]
    return head + body + b"".join(struct.pack(f"<B{len(f)}iH", len(f), *f, 7 + i) for i, f in enumerate(faces))


def test_readers(spark, tmp_path):
    for name, data in (("a", ASCII), ("b", binary(False)), ("c", binary(True))):
        (tmp_path / f"{name}.ply").write_bytes(data)
    v = ply.vertices(spark, f"{tmp_path}/*.ply").collect()
    assert len(v) == 12 and {(r.x, r.y, r.z) for r in v if r.vertex_id == 3} == {(0.0, 1.0, 0.5)}
    t = ply.triangles(spark, f"{tmp_path}/*.ply").collect()
    got = {n: sorted((r.face_id, r.v0, r.v1, r.v2, r.object_id) for r in t if r.path.endswith(f"{n}.ply")) for n in "abc"}
    assert got["a"] == [(0, 0, 1, 2, None), (0, 0, 2, 3, None), (1, 0, 1, 2, None)]
    assert got["b"] == [(0, 0, 1, 2, 7), (0, 0, 2, 3, 7), (1, 3, 1, 0, 8), (1, 3, 2, 1, 8)] and got["c"] == [(0, 0, 1, 2, 7), (0, 0, 2, 3, 7), (1, 0, 1, 2, 8)]


def test_errors():
    with pytest.raises(ValueError):
        ply.parse(b"plx")
    with pytest.raises(ValueError):
        ply.parse(ASCII.replace(b"ascii", b"binary_big_endian"))
