import hashlib
import random

import numpy as np
import pytest

from roomscope.llm import suffixes


def brute(rows, least):
    seen, out = {}, []
    place = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    result = {}
    for i in place:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            s = raw[p : p + least]
            if s in seen:
                gone[p : p + least] = b"\1" * least
            else:
                seen[s] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        result[i] = (rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((result[i] for i in range(len(rows))), key=str)


def make(seed, least):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdeéß ") for _ in range(random.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [random.choice(shared) if random.random() < 0.3 else text(random.randrange(0, 40)) for _ in range(random.randrange(0, 5))]
        t = " ".join(parts)
        if rows and random.random() < 0.2:
            t = rows[random.randrange(len(rows))][1] or ""
            if random.random() < 0.6 and len(t) > 5:
                k = random.randrange(len(t))
                t = t[:k] + word() + t[k + 3 :]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, "a" * least), (204, "ab" * 300), (205, "a" * (least - 1)), (206, "xyz" * 500 + shared[0] * 3), (None, shared[1] + "q"), (5, shared[2])]
    random.shuffle(rows)
    return rows


def test_arrays_against_brute():
    random.seed(1)
    for _ in range(60):
        t = "".join(random.choice("ab") for _ in range(random.randrange(1, 60)))
        a = np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int64)
        assert suffixes.suffix_order(a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        most = random.randrange(1, 12)
        got = suffixes.previous_factor(a, most).tolist()
        for i in range(len(t)):
            best = max((k for k in range(min(most, len(t) - i) + 1) if any(t[j : j + k] == t[i : i + k] for j in range(i)) or k == 0), default=0)
            assert (got[i] >= most) == (best >= most)
            assert got[i] <= best


@pytest.mark.parametrize(("seed", "least", "gram", "at_once"), [(1, 100, 40, 2048), (1, 100, 40, 3), (2, 30, 12, 2)])
def test_against_brute(spark, seed, least, gram, at_once):
    """Anchors with more than ``at_once`` kinds of surroundings are split over shards."""
    rows = make(seed, least)
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_bytes string").repartition(7)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeated_passages(d, least, gram, at_once).collect()), key=str)
    assert [g[:4] for g in got if g[0] not in (5, None)] == [w[:4] for w in brute(rows, least) if w[0] not in (5, None)]
    assert got == brute(rows, least)


def test_empty_and_columns(spark):
    d = spark.createDataFrame([(2, "w" * 150, "en", "s", 150), (1, "w" * 150, "en", "s", 150), (3, "kept é", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffixes.repeated_passages(d.limit(0)).count() == 0
    out = suffixes.without_repeats(d)
    assert out.columns == d.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3} and got[3].text == "kept é" and got[3].n_chars is None


def test_clashing_names_null_and_long_texts(spark):
    random.seed(8)
    long = "".join(random.choice("abcdefgh ") for _ in range(2 * suffixes.PIECE))
    rows = [(1, "p" + long, 1, "x", 2.0), (2, "q" + long[5:] + "!", 3, "y", 4.0), (3, None, 5, None, None), (4, "", 6, "z", 7.0), (5, "own", 8, "w", 9.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, block int, row string, b double")
    got = {r.doc_id: r for r in suffixes.without_repeats(d).collect()}
    assert got[1].text == "p" + long and got[2].text == "q!" and got[3].text is None and got[4].text == "" and got[5].text == "own"
    assert [tuple(got[r[0]])[2:] for r in rows] == [r[2:] for r in rows]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("roomscope_blocks")]


def test_messages_grow_with_the_input(spark):
    """Rows sent are at most blocks times shards, and a block sends none to a shard that it has nothing for."""
    sent = []
    for n in (4, 8):
        d = spark.createDataFrame([(i, "".join(random.choice("abcd ") for _ in range(400))) for i in range(5 * n)], "doc_id long, text string").repartition(n)
        with suffixes.Blocks(d, shards=5000) as blocks:
            sent.append(blocks.emit(suffixes._send_anchors(5000, 100, 40)).count())
    assert 1.5 < sent[1] / sent[0] < 2.6 and sent[1] < 8 * 5000 / 10


def test_anchors_spread_over_shards():
    import pyarrow as pa

    random.seed(12)
    texts = ["".join(random.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40, pa.int32()), pa.array(range(40)), pa.array(range(40)), pa.array([t.encode() for t in texts])], names=["block", "row", "doc_id", "text"])
    size = np.zeros(16)
    for out in suffixes._send_anchors(16, 100, 40)(iter([batch])):
        for s, p in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
            size[s] += len(p)
    assert size.max() < 1.5 * size.mean()


def test_large_groups_go_in_parts():
    random.seed(3)
    width, left, least = 160, 60, 100
    base = [bytes(random.choice(b"ab") for _ in range(width)) for _ in range(5)]
    rows = []
    for _ in range(60):
        t = bytearray(random.choice(base))
        if random.random() < 0.5:
            t[random.randrange(width)] = 99
        rows.append(bytes(t))
    chars = np.array([list(r) for r in rows], dtype=np.uint8)
    absent = np.zeros_like(chars, dtype=bool)
    want = {(i, x) for i, r in enumerate(rows) for x in range(left + 1) if any(q[x : x + least] == r[x : x + least] for q in rows[:i])}
    for at_once in (7, 1000):
        got = {(int(i), int(x)) for a, b in suffixes._earlier(np.zeros(60, dtype=np.uint32), chars, absent, left, least, at_once) for i, x in zip(a, b, strict=True)}
        assert got == want


def test_place_orders_give_previous_factors():
    random.seed(4)
    width, left, least = 48, 18, 30
    for n in (1, 2, 40):
        base = [[random.choice((0, 97, 98)) for _ in range(width)] for _ in range(3)]
        chars = np.array([[c if random.random() < 0.97 else 99 for c in random.choice(base)] for _ in range(n)], dtype=np.uint8)
        absent = np.zeros_like(chars, dtype=bool)
        for i in range(0, n, 3):
            absent[i, : random.randrange(20)] = absent[i, width - random.randrange(20) :] = True
        chars[absent] = 0
        h = np.array([i % 2 for i in range(n)], dtype=np.uint32)
        got = suffixes._previous_factors(h, chars, absent, left, least)
        symbol = [[None if absent[i, x] else (h[i], x, chars[i, x]) for x in range(width)] for i in range(n)]
        run = lambda a, b, x: next((k for k in range(least) if symbol[a][x + k] is None or symbol[a][x + k] != symbol[b][x + k]), least)
        want = [[max((run(i, j, x) for j in range(i)), default=0) for x in range(left + 1)] for i in range(n)]
        assert got.tolist() == want
        # The array of the plain construction, over the same symbols in one string.
        text = ((h.astype(np.int64)[:, None] * width + np.arange(width)) << 8) + chars + 1
        if not absent.any():
            assert (suffixes.previous_factor(np.pad(text, ((0, 0), (0, 1))).ravel(), least).reshape(n, width + 1)[:, : left + 1] >= least).tolist() == (got >= least).tolist()


def test_zero_bytes_are_no_missing_bytes():
    tail = bytes(range(65, 65 + 29))
    chars = np.array([list(b"\0" * 19 + tail), list(b"\0" * 19 + tail)], dtype=np.uint8)
    absent = np.zeros_like(chars, dtype=bool)
    absent[0, :19] = True  # the first text begins there; the second has zeros
    assert len(suffixes._factor_hits(np.zeros(2, dtype=np.uint32), chars, absent, 18, 30)[0]) == 0


def test_previous_factors_come_from_smaller_positions(monkeypatch):
    asked = []
    monkeypatch.setattr(suffixes, "smaller", lambda order, f=suffixes.smaller: asked.append(len(order)) or f(order))
    chars = np.array([[97] * 48] * 3, dtype=np.uint8)
    i, x = suffixes._factor_hits(np.zeros(3, dtype=np.uint32), chars, np.zeros_like(chars, dtype=bool), 18, 30)
    assert asked == [3 * 19] and len(i) == 2 * 19


def test_factors_of_single_strings():
    random.seed(9)
    rows = [bytes(random.choice(b"ab\0") for _ in range(6)) for _ in range(80)]
    h = np.sort(np.array([random.randrange(3) for _ in rows], dtype=np.uint32))
    got = suffixes._factors_of_strings(h, np.array([list(r) for r in rows], dtype=np.uint8))
    same = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
    assert got.tolist() == [max((same(rows[i], rows[j]) for j in range(i) if h[j] == h[i]), default=0) for i in range(80)]
