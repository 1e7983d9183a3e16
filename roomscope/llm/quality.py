"""Quality classifier (operator 6): a generalised additive model with pairwise interactions.

Each text gives a fixed row of numbers, each number falls into a bin. Learning is cyclic boosting: feature after feature a shallow
tree of a few cuts over that feature's bins is fitted to the current residuals and added, shrunk, to the feature's lookup table;
then pairs of features, picked by how much of the rest their joint bins explain, get tables by trees of one cut on each axis.
A score is the logistic of the sum of one entry per table: binning and additions on whole batches.

Learning reads the texts of at most ``sample`` labelled ids, those of smallest hash of the id; scoring reads every text whole, however
long it is. Null texts are empty texts, and an empty text has a score as any other. Other columns aren't read, so their names can't
clash; an empty table gives an empty result. Without labels of both kinds every score is the share of label 1 (0.5
where there are none). Repeated rows get equal scores. No input but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

NAMES = (
    "log_bytes", "upper_share", "bang_per_word", "bar_per_word", "symbol_per_word", "digit_share", "word_bytes", "line_bytes", "stop_per_word",
    "comma_per_word", "wide_share", "distinct_words", "repeated_lines", "short_words", "slash_per_word", "quote_per_word", "tail_upper", "tail_symbol",
    "next_same", "most_bars",
)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def features(text: bytes) -> list[float]:
    """The numbers of one text, all from the text itself; shares are over at least one item, so empty texts are defined."""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    size = max(1, len(text))
    upper, lower = int(n[65:91].sum()), int(n[97:123].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = int(n[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    tail = np.bincount(np.frombuffer(text[len(text) // 2 :], dtype=np.uint8), minlength=256)
    tail_letters = max(1, int(tail[65:91].sum() + tail[97:123].sum()))
    return [
        float(np.log1p(len(text))), upper / max(1, upper + lower), int(n[33]) / w, int(n[124]) / w, symbols / w, int(n[48:58].sum()) / size,
        min(60.0, sum(map(len, words)) / w), min(4000.0, len(text) / max(1, len(lines))), int(n[46] + n[63]) / w, int(n[44]) / w, int(n[128:].sum()) / size,
        len(set(words)) / w, 1 - len(set(lines)) / max(1, len(lines)), sum(map((4).__gt__, map(len, words))) / w, int(n[47] + n[58] + n[61]) / w,
        int(n[34] + n[39] + n[40] + n[41]) / w, int(tail[65:91].sum()) / tail_letters, int(tail[[33, 35, 36, 37, 38, 42, 124]].sum()) / max(1, len(text) // 2),
        sum(map(eq, words, words[1:])) / w, min(40.0, max((x.count(b"|") for x in lines), default=0)),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(NAMES))


@dataclass
class Additive:
    """Lookup tables: one per feature over its bins, one per chosen pair over coarser bins."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.edges[j], x[:, j], side="right")]
        cut = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        for a, b, t in self.pairs:
            total += t[cut[a], cut[b]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.square(g) / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree of up to ``leaves`` leaves over ordered bins with gradient and curvature sums: the value of each bin."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            gain[(ch[at] - ch[a] < 1) | (ch[b] - ch[at] < 1)] = 0
            if (m := int(np.argmax(gain))) is not None and gain[m] > best[0]:
                best = (float(gain[m]), k, int(at[m]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on each axis of a grid of sums: the gain and the four values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        top, low = cg[i], cg[-1] - cg[i]
        toph, lowh = ch[i], ch[-1] - ch[i]
        quarters = ((top[:-1], toph[:-1]), (top[-1] - top[:-1], toph[-1] - toph[:-1]), (low[:-1], lowh[:-1]), (low[-1] - low[:-1], lowh[-1] - lowh[:-1]))
        gain = sum(_gain(a, b) for a, b in quarters)
        j = int(np.argmax(gain))
        if gain[j] > best:
            best = float(gain[j])
            v = [a[j] / (b[j] + 1.0) for a, b in quarters]
            out = np.zeros_like(g)
            out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def learn(x: np.ndarray, y: np.ndarray, rounds: int = 120, bins: int = 48, grid: int = 8, pairs: int = 8, rate: float = 0.12, leaves: int = 4) -> Additive:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = Additive(start=float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return m
    cuts = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
    m.edges, m.coarse = cuts(bins), cuts(grid)
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.start)

    def sums(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    for _ in range(rounds):
        for j, at in enumerate(fine):
            step = rate * _tree(*sums(at, len(m.tables[j])), leaves)
            m.tables[j] += step
            total += step[at]
    found = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
            g, h = sums(rough[a] * shape[1] + rough[b], shape[0] * shape[1])
            found.append((_tree2(g.reshape(shape), h.reshape(shape))[0], a, b))
    chosen = [(a, b, np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))) for _, a, b in sorted(found, reverse=True)[:pairs]]
    for _ in range(rounds // 3):
        for a, b, t in chosen:
            at = rough[a] * t.shape[1] + rough[b]
            g, h = sums(at, t.size)
            step = rate * _tree2(g.reshape(t.shape), h.reshape(t.shape))[1]
            t += step
            total += step.ravel()[at]
    m.pairs = chosen
    return m


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix([t or b"" for t in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["label", *(f"f{j}" for j in range(x.shape[1]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, mod: int = 5) -> Additive:
    """Learn from at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(fold("doc_id", mod) != 0)
    # The sample's size is the bound of this broadcast: 20,000 ids and labels are about 300 KB.
    # Of labels that contradict each other the worse one counts, so that learning is the same every time.
    chosen = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    wide = joined.select("text", "label").mapInArrow(_wide, "label int, " + ", ".join(f"f{j} double" for j in range(len(NAMES))))
    rows = wide.toPandas().to_numpy(dtype=np.float64)
    rows = rows[np.lexsort(rows.T)] if len(rows) else rows.reshape(0, len(NAMES) + 1)
    return learn(rows[:, 1:], rows[:, 0])


def _scorer(model: Additive, spark):
    held = spark.sparkContext.broadcast(model)

    def scores(texts: list) -> np.ndarray:
        return held.value.score(matrix([t or b"" for t in texts]))

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, sample: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. A null id counts as held out."""
    scores = _scorer(train(docs, labels, sample, mod), docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold("doc_id", mod) == 0, F.lit(True)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are."""
    scores = _scorer(train(all_docs, labels, sample), docs.sparkSession)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = scores([None if t is None else t.encode() for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
