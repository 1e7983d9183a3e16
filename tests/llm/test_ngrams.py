import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from roomscope.llm import ngrams


def test_elias_fano():
    random.seed(1)
    for n, top in ((0, 1), (1, 5), (200, 300), (500, 1 << 40), (300, 3)):
        a = np.sort(np.array([random.randrange(top) for _ in range(n)], dtype=np.int64))
        e = ngrams.EliasFano(*ngrams.EliasFano.code(a))
        assert e.get(np.arange(n)).tolist() == a.tolist()
        if n:
            x = np.array([random.randrange(top + top // 3 + 1) for _ in range(400)] + a.tolist(), dtype=np.int64)
            lo = np.array([random.randrange(n) for _ in x])
            hi = np.array([random.randrange(i, n + 1) for i in lo])
            want = [next((k for k in range(i, j) if a[k] >= y), j) for y, i, j in zip(x, lo, hi, strict=True)]
            assert e.successor(x, lo, hi).tolist() == want


def test_decodes_a_window_at_a_time(monkeypatch):
    monkeypatch.setattr(ngrams.EliasFano, "WINDOW", 64)
    random.seed(4)
    a = np.cumsum([random.randrange(300) for _ in range(5000)])
    n, bits, low, high, select = ngrams.EliasFano.code(a)
    e = ngrams.EliasFano(n, bits, low, high, select)
    i = np.array([random.randrange(5000) for _ in range(900)])
    assert e.get(i).tolist() == a[i].tolist()
    x = np.array([random.randrange(int(a[-1]) + 9) for _ in range(900)])
    assert e.successor(x, np.zeros(900, dtype=np.int64), np.full(900, 5000)).tolist() == np.searchsorted(a, x).tolist()
    assert len(low) + len(high) < 2 * 5000  # about 2 + log2(150) bits each
    held = sum(v.nbytes for v in vars(e).values() if isinstance(v, np.ndarray))
    assert held < 2 * (len(low) + len(high) + len(select) * 16)  # no unpacked copy is kept


def test_trie():
    random.seed(2)
    entries = sorted({(random.randrange(40), random.randrange(1 << 32)) for _ in range(900)})
    c, w = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
    code = np.array([random.randrange(1, 256) for _ in entries], dtype=np.uint8)
    t = ngrams.Trie([(40, c, w)], [code])
    ask = entries + [(3, 5), (7, 1), (-1, 2), (39, (1 << 32) - 1)]
    got = t.code(0, t.levels[0].find(np.array([x for x, _ in ask]), np.array([y for _, y in ask])))
    want = dict(zip(entries, code.tolist(), strict=True))
    assert got.tolist() == [want.get(x, 0) for x in ask]
    assert t.bytes < 8 * len(entries)


def brute(rows):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    train = [k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
    c, cc, follow = Counter(), Counter(), {}
    for x, ok in zip(toks, train, strict=True):
        if ok:
            c.update(x)
            cc.update(zip(["<s>", *x], x))
    for h, w in cc:
        follow[h] = follow.get(h, 0) + 1
    n, v = sum(c.values()), len(c)
    out = []
    for (k, _), x, ok in zip(rows, toks, train, strict=True):
        base = score = 0.0
        for h, w in zip(["<s>", *x], x):
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            total = c[None] if h == "<s>" else c[h]
            if total:
                seen = cc[h, w]
                q = float(ngrams.expand(ngrams.quantise(np.array([(seen - 0.75) / total])))[0]) if seen else 0.0
                p = q + 0.75 * follow[h] / total * p
            score += math.log10(min(p, 1.0))
        out.append((k, not ok, len(x), sum(c[w] > 0 for w in x), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 20, 30])
def test_against_brute(spark, hot):
    random.seed(3)
    words = ["the", "The", "of", "é!"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(words, weights=[30, 10, 10, 5] + [1] * 60, k=random.randrange(0, 80)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the of"), (3, rows[4][1]), (4, rows[4][1])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(4)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngrams.scored(d, hot=hot, order=2, stretch=500).collect()), key=lambda r: str(r[:5]))
    want = sorted(brute(rows), key=lambda r: str(r[:5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert sorted(round(g[5], 6) for g in got) == sorted(round(w[5], 6) for w in want)
    assert sorted(round(g[6], 6) for g in got) == sorted(round(w[6], 6) for w in want)


def test_sums_to_one_and_empty(spark):
    assert ngrams.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = ngrams.scored(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert only.n_tokens == 1 and only.base_score <= 0


def brute_three(rows):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    train = [k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
    one, more = Counter(), {}
    for x, ok in zip(toks, train, strict=True):
        if ok:
            one.update(x)
            for i, w in enumerate(x):
                more.setdefault((x[i - 1] if i else "<s>",), Counter())[w] += 1
                if i:
                    more.setdefault((x[i - 2] if i > 1 else "<s>", x[i - 1]), Counter())[w] += 1
    n, v, out = sum(one.values()), len(one), []
    for x in toks:
        score = 0.0
        for i, w in enumerate(x):
            p = (one[w] + 1) / (n + v + 1)
            for h in ((x[i - 1] if i else "<s>",), (x[i - 2] if i > 1 else "<s>", x[i - 1] if i else "")):
                if h in more:
                    total = sum(more[h].values())
                    q = float(ngrams.expand(ngrams.quantise(np.array([(more[h][w] - 0.75) / total])))[0]) if more[h][w] else 0.0
                    p = q + 0.75 * len(more[h]) / total * p
            score += math.log10(min(p, 1.0))
        out.append(round(score, 6))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 20, 10])
def test_trigrams_against_brute(spark, hot):
    random.seed(5)
    words = ["the", "The", "of", "é!"] + [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(random.choices(words, weights=[30, 20, 10, 5] + [1] * 20, k=random.randrange(0, 80)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the of"), (3, rows[4][1]), (4, rows[4][1])]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(4)
    assert sorted(round(r.score, 6) for r in ngrams.scored(d, hot=hot, stretch=500).collect()) == brute_three(rows)


def test_small_probabilities_keep_their_size():
    p = np.array([1.0, 0.3, 1e-9, 1e-12])
    steps = ngrams.steps_for(p)
    assert np.abs(np.log10(ngrams.expand(ngrams.quantise(p, steps), steps) / p)).max() < 0.5 / steps + 1e-9
    assert ngrams.steps_for(p[:2]) == ngrams.steps_for(p[:0]) == 32


def asked_of_a_shard(stretches, lasts, rare=1):
    """What so many stretches ask one shard: some last words, the words before them, and their successors."""
    r = np.random.default_rng(6)
    for k in range(stretches):
        name = r.choice(lasts * 3, lasts, replace=False).astype(np.uint32) + 1
        pair = [np.sort(r.choice(60, n, replace=False)) for n in r.integers(1, 20, lasts)]  # 0: no word before
        n_word = r.integers(0, 9, sum(map(len, pair))).astype(np.uint32)
        word = np.concatenate([r.choice(200, n, replace=False) for n in n_word]).astype(np.uint32) + 1
        times = r.integers(0, 4, len(word)).astype(np.uint32)
        times[::97] *= rare
        yield k, ngrams._squeeze(k, name, (name % 17 == 0).astype(np.uint8), np.array([len(x) for x in pair], dtype=np.uint32), np.concatenate(pair).astype(np.uint32), n_word, word, times)


@pytest.mark.parametrize("rare", [1, 1_000_000_000])
def test_groups_of_a_shard_change_no_answer(monkeypatch, rare):
    rows = list(asked_of_a_shard(3, 40, rare))
    whole = list(ngrams._answer_triples(rows))
    assert (ngrams._expanded(whole[0][1])[-1] < 32).all() == (rare > 1)
    for most in (1, 60):
        monkeypatch.setattr(ngrams, "GROUP", most)
        assert list(ngrams._answer_triples(rows)) == whole


def test_memory_of_a_shard():
    import tracemalloc

    rows = list(asked_of_a_shard(10, 4000))
    triples = sum(len(ngrams._expanded(p)[-1]) for _, p in rows)
    tracemalloc.start()
    for _ in ngrams._answer_triples(rows):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert triples > 1_500_000 and peak < 100 * triples
