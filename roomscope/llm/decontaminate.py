"""Benchmark decontamination (operator 1).

All windows of all normalised benchmark items form one Aho-Corasick automaton. A document is normalised once (lower-cased words
joined by single blanks), scanned once, and every match is mapped back to word numbers and to byte offsets of the original.

Windows are made and told apart by the executors, and their bytes are summed before any of them is sent. Up to ``most_bytes`` (an
automaton takes about 50 times as much memory) they are one broadcast and one scan. Beyond it they are dealt by hash into parts of
that size, one after the other: each is a broadcast and a scan of its own that leaves the runs it hit in the shared folder, and a
document's runs are merged at the end. So no task ever holds more than one part.

Null and empty texts have no words. Items without words have no windows; an item without an id hits, but has no name to be listed.
Repeated rows give repeated rows; items that share windows are all reported, in the order of their names; an empty benchmark gives
zero hits, an empty table an empty result. Texts of any length are read whole. Only doc_id and text (item_id and text) are read, so
other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_folder

WINDOW = 10
#: One byte for one byte: letters lower-cased, what is no digit, letter or non-ASCII byte a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Scanner:
    """An automaton over windows; each window knows its items."""

    def __init__(self, windows: dict[bytes, list[str]]):
        self.automaton = ahocorasick.Automaton()
        for w, items in windows.items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), w.count(b" ") + 1, tuple(items)))
        self.full = bool(windows)
        if self.full:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(byte of the last word's end in the normalised text, words, items) of each occurrence."""
        if not self.full or not words:
            return []
        return [(end, n, items) for end, (_, n, items) in self.automaton.iter(f" {b' '.join(words).decode('latin-1')} ")]


Run = tuple[int, int, int, int]  # first and last word, first byte and the one after the last


def find(text: bytes, scanner: Scanner) -> tuple[int, list[Run], list[str]]:
    """Words of the text, the runs of hit words, and the items found."""
    flat = text.translate(NORMAL)
    words = flat.split()
    found = scanner.matches(words)
    if not found:
        return len(words), [], []
    ends = np.cumsum([len(w) + 1 for w in words])  # a word's closing blank in the normalised text
    last = np.searchsorted(ends, [m[0] for m in found])
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(hit, last + 1, -1)
    np.add.at(hit, last + 1 - np.array([m[1] for m in found]), 1)
    hits = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
    blank = np.frombuffer(flat, dtype=np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    return len(words), [(int(r[0]), int(r[-1]), int(start[r[0]]), int(stop[r[-1]])) for r in runs], sorted({x for m in found for x in m[2]})


def merged(runs: list[Run]) -> list[Run]:
    """Runs of several scans as one list: those that overlap or touch become one."""
    out: list[Run] = []
    for r in sorted(runs):
        if out and r[0] <= out[-1][1] + 1:
            if r[1] > out[-1][1]:
                out[-1] = (out[-1][0], r[1], out[-1][2], r[3])
        else:
            out.append(r)
    return out


def without(raw: bytes, runs: list[Run]) -> str:
    at, out = 0, []
    for _, _, a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def window_table(benchmark: DataFrame, window: int) -> DataFrame:
    """(w, items): every distinct window and the ids of the items that hold it, null ids left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {(w, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for w in windows_of(words_of(t), window)}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([i for _, i in pairs], pa.string())], names=["w", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "w binary, item string").groupBy("w").agg(F.collect_set("item").alias("items"))


class Dealt:
    """The windows of a benchmark in parts of at most about ``most_bytes``."""

    def __init__(self, benchmark: DataFrame, window: int, most_bytes: int):
        self.table = settle(window_table(benchmark, window))
        total = self.table.agg(F.coalesce(F.sum(F.length("w") + F.lit(2)), F.lit(0))).first()[0]
        self.parts = max(1, math.ceil(total / most_bytes))
        self.context = benchmark.sparkSession.sparkContext

    def broadcast(self, part: int):
        rows = self.table.where(F.pmod(F.xxhash64("w"), F.lit(self.parts)) == part).collect()
        return self.context.broadcast({bytes(r.w): list(r["items"]) for r in rows})


RUNS = "array<struct<first:int,last:int,start:int,stop:int>>"
_RUN = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "start", "stop")]))


def _structs(runs: list[Run]) -> list[dict[str, int]]:
    return [{"first": a, "last": b, "start": c, "stop": d} for a, b, c, d in runs]


def _scan(windows, use: Callable[[pa.RecordBatch, list[tuple[int, list[Run], list[str]]]], pa.RecordBatch], at_text: int):
    """``use`` makes a batch of the rows of one and what was found in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(windows.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(at_text).to_pylist()
                yield use(part, [find(t.encode() if isinstance(t, str) else t or b"", scanner) for t in texts])

    return run


def _in_parts(docs: DataFrame, dealt: Dealt) -> DataFrame:
    """(row, n_words, runs, items) of each row of ``docs`` (row, text), over all parts."""
    folder = f"{shared_folder(docs.sparkSession)}/roomscope_runs_{uuid.uuid4().hex}"

    def use(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        cols = [part.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array([_structs(r) for _, r, _ in found], _RUN), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["row", "n_words", "runs", "items"])

    for k in range(dealt.parts):
        windows = dealt.broadcast(k)
        docs.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(_scan(windows, use, 1), f"row long, n_words long, runs {RUNS}, items array<string>").write.mode("append").parquet(folder)
        windows.unpersist()
    rows = docs.sparkSession.read.parquet(folder)
    return rows.groupBy("row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,stop:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _report(ids: pa.Array, found: list[tuple[int, list[Run], list[str]]]) -> pa.RecordBatch:
    hits = [sum(b - a + 1 for a, b, _, _ in runs) for _, runs, _ in found]
    cols = [
        ids.cast(pa.int64()), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for _, _, x in found], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in found], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()),
        pa.array([[{"start": c, "stop": d} for _, _, c, d in runs] for _, runs, _ in found], _SPAN),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with counts, the digest of the items found and the hit spans."""
    dealt = Dealt(benchmark, window, most_bytes)
    if dealt.parts == 1:
        use = lambda part, found: _report(part.column(0), found)
        return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scan(dealt.broadcast(0), use, 1), SCHEMA)
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _report(batch.column(0), _merged_rows(batch, 1))

    return rows.select("row", "doc_id").join(_in_parts(rows, dealt), "row").select("doc_id", "n_words", "runs", "items").mapInArrow(run, SCHEMA)


def _merged_rows(batch: pa.RecordBatch, at: int) -> list[tuple[int, list[Run], list[str]]]:
    """From the columns n_words, runs and items, the first of which is number ``at``."""
    n, runs, items = (batch.column(at + k).to_pylist() for k in range(3))
    return [(a, merged([(r["first"], r["last"], r["start"], r["stop"]) for r in b]), c) for a, b, c in zip(n, runs, items, strict=True)]


def cut_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = 8 << 20, drop_share: float = 0.5) -> DataFrame:
    """``docs`` with the hit passages cut out of their texts; a document mostly made of them is dropped.

    All columns are kept; ``n_chars``, where there is one, is the length of the new text. Untouched documents keep their bytes, null
    texts stay null.
    """
    dealt = Dealt(benchmark, window, most_bytes)
    at_text = docs.columns.index("text")
    at_n = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(part: pa.RecordBatch, found: list[tuple[int, list[Run], list[str]]]) -> pa.RecordBatch:
        texts = part.column(at_text).to_pylist()
        new = {i: without(texts[i].encode(), runs) for i, (_, runs, _) in enumerate(found) if runs}
        keep = [sum(b - a + 1 for a, b, _, _ in runs) <= drop_share * n for n, runs, _ in found]
        if new:
            texts = [new.get(i, t) for i, t in enumerate(texts)]
            part = part.set_column(at_text, part.schema.field(at_text), pa.array(texts, part.schema.field(at_text).type))
            if at_n is not None:
                n = [len(texts[i]) if i in new else x for i, x in enumerate(part.column(at_n).to_pylist())]
                part = part.set_column(at_n, part.schema.field(at_n), pa.array(n, part.schema.field(at_n).type))
        return part.filter(pa.array(keep, pa.bool_()))

    if dealt.parts == 1:
        return docs.mapInArrow(_scan(dealt.broadcast(0), cut, at_text), docs.schema)
    width, names = len(docs.columns), [f"c{i}" for i in range(len(docs.columns))]
    rows = settle(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    found = _in_parts(rows.select("row", F.col(names[at_text]).alias("text")), dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays(batch.columns[:width], names=docs_names)
            yield cut(part, _merged_rows(batch, width))

    docs_names = docs.columns
    return rows.join(found, "row").select(*names, "n_words", "runs", "items").mapInArrow(run, docs.schema)


#: By definition, for small data: words and windows as strings, one row for each word of an occurrence.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS g
        FROM bw, range(0, greatest(1, len(w) - 9)) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS i, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS g
          FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) t(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
