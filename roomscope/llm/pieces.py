"""SentencePiece encoding and decoding with byte offsets (operator 9).

A model file is read as plain protobuf wire data. A text is normalised by longest-prefix matching in the model's compiled
character map (a double-array trie), each output byte recording the source position it came from; the normalised string is
cut where no vocabulary piece can cross (before a run of word markers, around new lines), each cut piece is merged by
byte-pair rank, and every resulting piece is projected back to the original byte span. Cut pieces repeat, so each worker keeps
a bounded memo of them.

Null and empty texts have no pieces; every text is encoded whole. Other columns of the input are passed over.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            x = b[i]
            i += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield key >> 3, b[i : i + n]
        i += n


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 source strings and a pool of replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.pool = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, b: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source string at ``at`` and its replacement."""
        if not self.units:
            return None
        units, pos, found = self.units, 0, None
        pos ^= self._offset(units[0])
        for i in range(at, len(b)):
            pos ^= b[i]
            unit = units[pos]
            if unit & 0x800000FF != b[i]:
                break
            pos ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[pos] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found


class _Memo(dict):
    """Ids of the segments met so far, up to a number, comma-joined and as integers."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, s: str) -> tuple[str, bytes]:
        got = self.model._ids(s)
        if len(s) < 200:
            if len(self) >= self.model._limit:
                self.shrink()
            self[s] = got
        return got

    def shrink(self) -> None:
        """Down to a quarter of the limit: those met first, as the frequent ones are among them."""
        kept = list(islice(self.items(), self.model._limit // 4))
        self.clear()
        self.update(kept)


class PieceModel:
    def __init__(self, data: bytes, memo: int = 300_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        norm: dict = {3: 1, 4: 1, 5: 1, 2: b""}
        model_type, suffix = 1, 0
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.types.append(p.get(3, NORMAL))
            elif field == 2:
                t = dict(_fields(value))
                model_type, suffix = t.get(3, 1), t.get(24, 0)
            elif field == 3:
                norm |= dict(_fields(value))
        if model_type != 2 or suffix:
            raise ValueError("only byte-pair models with word markers in front are supported")
        self.map = CharMap(norm[2])
        self.dummy, self.squeeze, self.escape = bool(norm[3]), bool(norm[4]), bool(norm[5])
        self.vocab = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER, UNUSED)}
        self.user = sorted((p for p, t in zip(self.pieces, self.types, strict=True) if t == USER), key=len, reverse=True)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self._rank = {p: self.scores[i] for p, i in self.vocab.items()}
        self.unknown = self.types.index(UNKNOWN)
        self.unused = any(t == UNUSED for t in self.types)
        # Cuts are safe where no piece could span them: before a marker, and around a new line.
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.vocab)
        self._cut = re.compile(r"(?s).+" if inner or self.user else r"\n|[ ▁]+[^ ▁\n]*|[^ ▁\n]+")
        # Bytes of each piece with a blank for the marker; 0 of bytes of longer characters, -1 of what doesn't stand for itself.
        self._sizes = np.array([len(p.replace(MARK, " ").encode()) if i == self.vocab.get(p) else -1 for i, p in enumerate(self.pieces)], dtype=np.int64)
        self._starts = np.zeros(len(self.pieces), dtype=bool)
        for x, i in self.byte_ids.items():
            self._sizes[i] = x < 0x80
            self._starts[i] = x >= 0xC0
        self._said = list(map(str, range(len(self.pieces))))
        self._limit = memo
        self._memo = _Memo(self)

    @classmethod
    def load(cls, path: str, **more) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read(), **more)

    # normalising -------------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised string, and for each of its characters plus the end the byte of the source it starts at."""
        b = text.encode()
        out: list[str] = []
        src: list[int] = []

        def put(s: str, at: int) -> None:
            for c in s:
                out.append(MARK if self.escape and c == " " else c)
                src.append(at)

        chunks: list[tuple[str, int, int]] = []
        i = 0
        while i < len(b):
            user = next((p for p in self.user if b.startswith(p.encode(), i)), None)
            hit = None if user else self.map.longest(b, i)
            if user:
                n, s = len(user.encode()), user
            elif hit:
                n, s = hit[0], hit[1].decode()
            else:
                n = 1 if b[i] < 0x80 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
                s = b[i : i + n].decode()
            chunks.append((s, i, i + n))
            i += n
        end = len(b)
        if self.squeeze:
            while chunks and not chunks[0][0].strip(" "):
                chunks.pop(0)
        if not chunks:
            return "", np.zeros(1, dtype=np.int64)
        if self.dummy:
            put(" ", chunks[0][1])
        space = self.squeeze
        for s, at, _ in chunks:
            if self.squeeze and space:
                s = s.lstrip(" ")
            if s:
                put(s, at)
                space = s.endswith(" ")
        if self.squeeze:
            while out and out[-1] in (MARK, " "):
                out.pop()
                end = src.pop()
        return "".join(out), np.array([*src, end], dtype=np.int64)

    # merging -----------------------------------------------------------------------------------------------------------

    def merge(self, s: str) -> list[str]:
        """Byte-pair merging: the best score first, the leftmost of equals."""
        if len(s) <= 64 and not self.user and not self.unused:
            return self._merge_short(s)
        parts: list[str] = []
        i = 0
        while i < len(s):
            user = next((p for p in self.user if s.startswith(p, i)), None)
            parts.append(user or s[i])
            i += len(parts[-1])
        frozen = [len(p) > 1 or p in self.user for p in parts] if self.user else None
        n = len(parts)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []
        vocab, scores = self.vocab, self.scores
        made: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or frozen and (frozen[a] or frozen[b]):
                return
            both = parts[a] + parts[b]
            k = vocab.get(both)
            if k is not None:
                heapq.heappush(heap, (-scores[k], a, b, both))
                if self.types[k] == UNUSED:
                    made[both] = (parts[a], parts[b])

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])

        def resolve(p: str) -> list[str]:
            if p in made and self.types[vocab[p]] == UNUSED:
                return [y for x in made[p] for y in resolve(x)]
            return [p]

        whole = [p for p in parts if p]
        return [y for p in whole for y in resolve(p)] if self.unused else whole

    def _merge_short(self, s: str) -> list[str]:
        """The same for a short string, without a heap: list operations beat it there."""
        parts = list(s)
        get, none = self._rank.get, -math.inf
        sc = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while sc:
            best = max(sc)
            if best == none:
                break
            i = sc.index(best)
            parts[i] += parts.pop(i + 1)
            del sc[i]
            if i:
                sc[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(sc):
                sc[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _pieces(self, s: str) -> list[tuple[int, int]]:
        """(id, characters) of a normalised string; the bytes of an unknown character share it, the last one ending it."""
        out = []
        for p in self.merge(s):
            k = self.vocab.get(p)
            if k is not None:
                out.append((k, len(p)))
            elif self.byte_ids:
                raw = p.encode()
                out += [(self.byte_ids[x], len(p) if j == len(raw) - 1 else 0) for j, x in enumerate(raw)]
            else:
                out.append((self.unknown, len(p)))
        return out

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and the original byte span of every piece."""
        s, src = self.normalise(text)
        ids: list[int] = []
        ends: list[int] = []
        at = 0
        for m in self._cut.finditer(s):
            for k, n in self._pieces(m[0]):
                at += n
                ids.append(k)
                ends.append(at)
        end = src[np.array(ends, dtype=np.int64)] if ends else np.zeros(0, dtype=np.int64)
        begin = np.concatenate((src[:1], end[:-1])) if ends else end
        return ids, begin, end

    @property
    def plain(self) -> bool:
        """True where the map is empty, so that the alignment is the identity but for word markers."""
        return not self.map.units and not self.squeeze and self.escape and self.dummy and not self.user

    def _ids(self, s: str) -> tuple[str, bytes]:
        marked = s.replace(" ", MARK)
        ids = list(map(self.vocab.get, self.merge(marked)))
        if None in ids:
            ids = [k for k, _ in self._pieces(marked)]
        return ",".join(map(self._said.__getitem__, ids)), array("i", ids).tobytes()

    def _sizes_of(self, ids: np.ndarray) -> np.ndarray | None:
        """Bytes of the text that each piece takes, those of a character told by its bytes at the last one; None where ids don't say."""
        size = self._sizes[ids]
        least = int(size.min())
        if least < 0:
            return None
        if least == 0:
            byte, start = size == 0, self._starts[ids]
            last = np.flatnonzero(byte & np.append(~byte[1:] | start[1:], True))
            size[last] = last - np.flatnonzero(start) + 1
        return size

    def _segment(self, s: str) -> tuple[str, bytes, bytes, bytes]:
        """Ids comma-joined, the ends of the pieces in the segment's bytes, the decoded bytes, and the ids as integers."""
        marked = s.replace(" ", MARK)
        parts = self.merge(marked)
        ids = list(map(self.vocab.get, parts))
        if None in ids:
            got = self._pieces(marked)
            ids = [k for k, _ in got]
            ends = accumulate([n for _, n in got])
            raw = self._raw(ids)
        else:
            ends = accumulate(map(len, parts))
            raw = s.replace(MARK, " ").encode()
        if not s.isascii():
            upto = [0, *accumulate([len(c.encode()) for c in s])]
            ends = [upto[x] for x in ends]
        return ",".join(map(str, ids)), array("i", ends).tobytes(), raw, array("i", ids).tobytes()

    def digest(self, text: str) -> tuple[np.ndarray, str, str, np.ndarray]:
        """The ids, the ids comma-joined, the decoded text, and the end of each piece in the text's bytes."""
        if not self.plain:
            ids, _, end = self.encode(text)
            return np.array(ids, dtype=np.int32), ",".join(map(str, ids)), self.decode(ids), end
        if not text:
            return np.zeros(0, dtype=np.int32), "", "", np.zeros(0, dtype=np.int32)
        segments = self._cut.findall(" " + text)
        if MARK not in text:
            said, ids = zip(*map(self._memo.__getitem__, segments), strict=True)
            ids = np.frombuffer(b"".join(ids), dtype=np.int32)
            size = self._sizes_of(ids)
            if size is not None:  # every piece stands for its own characters, so that they decode to the text
                return ids, ",".join(said), text, np.maximum(np.cumsum(size) - 1, 0)
        # No character's bytes are shared by two segments, so each is decoded alone.
        said, ends, back, ids = zip(*map(self._segment, segments), strict=True)
        counts = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends)) // 4
        end = np.frombuffer(b"".join(ends), dtype=np.int32)
        size = end[np.cumsum(counts) - 1]  # a segment's last piece ends where it does
        base = np.cumsum(size, dtype=np.int64) - size - 1  # the first blank is not in the text
        out = b"".join(back).decode()
        if out.startswith(" ") and self.pieces[int(said[0].split(",", 1)[0])].startswith(MARK):
            out = out[1:]
        return np.frombuffer(b"".join(ids), dtype=np.int32), ",".join(said), out, np.maximum(end + np.repeat(base, counts), 0)

    # decoding ----------------------------------------------------------------------------------------------------------

    def _raw(self, ids: list[int]) -> bytes:
        out: list[bytes] = []
        held = bytearray()

        def flush() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for k in ids:
            if k in self.byte_of:
                held.append(self.byte_of[k])
                continue
            flush()
            if self.types[k] == CONTROL:
                continue
            out.append(" ⁇ ".encode() if k == self.unknown else self.pieces[k].replace(MARK, " ").encode())
        flush()
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        seen = next((k for k in ids if self.types[k] != CONTROL), None)
        text = self._raw(ids).decode()
        return text[1:] if seen is not None and (self.dummy or self.squeeze) and self.pieces[seen].startswith(MARK) and text.startswith(" ") else text


def _utf8(raw: bytes) -> bytes:
    """Well-formed characters stay; each other byte becomes the replacement character."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    raw[i : i + n].decode()
                    out.append(raw[i : i + n])
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                i += 1
        return b"".join(out)


_LOADED: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"


def piece_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): digests of ids, of the decoded text and of the pieces' end offsets.

    With ``with_ids`` the ids themselves come as well.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    held = docs.sparkSession.sparkContext.broadcast(data)  # one vocabulary file, about half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, a, b, c, all_ids = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    ids, joined, back, end = model.digest(t or "")
                    n.append(len(ids))
                    a.append(_sha(joined))
                    b.append(_sha(back))
                    c.append(hashlib.sha256(end.astype("<i8").tobytes()).hexdigest())
                    all_ids.append(ids)
                cols = [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(all_ids))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256", "ids"][: len(cols)])
        model._memo.shrink()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


PIECES = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """The general form: ids, original byte span of every piece, and the decoded text, per row of ``docs``."""
    with open(model_path, "rb") as f:
        data = f.read()
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [model.encode(t or "") for t in part.column(1).to_pylist()]
                kinds = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([g[0] for g in got], kinds), pa.array([g[1].tolist() for g in got], kinds), pa.array([g[2].tolist() for g in got], kinds), pa.array([model.decode(g[0]) for g in got])], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
