import random
import re

import numpy as np

from roomscope.llm import graphs, jaccard


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return sorted(((k, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def make(seed, groups=12):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(300)] + ["The", "oF", "é!", "x|"]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    rows, shared = [], text(60)
    for g in range(groups):
        base = text(random.choice([6, 30, 80, 200]))
        for _ in range(random.randrange(1, 14)):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                k = random.randrange(len(t))
                t[k : k + random.randrange(2)] = [random.choice(vocab)]
            rows.append(" ".join(t) if random.random() < 0.8 else "\t".join(t).upper())
        rows.append(" ".join(text(25) + shared))
    rows += ["a", "a", "A b", "a b", "a b c", "", "   ", None, None, "one two three four", " ".join(["same"] * 500), " ".join(["same"] * 900), " ".join(text(4000))]
    out = [(i, t) for i, t in enumerate(rows)]
    out += [(3, rows[0]), (None, rows[1]), (None, "all alone in here"), (900, rows[5])]
    random.shuffle(out)
    return out


def test_against_brute(spark):
    for seed, words, percent in ((1, 4, 85), (2, 5, 80)):
        rows = make(seed)
        d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(5)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(d, words, percent).collect()), key=str)
        assert got == brute(rows, words, percent)


def test_empty_and_stage(spark):
    d = spark.createDataFrame([(2, "a b c d e f g", "en"), (1, "a b c d e f g", "en"), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert jaccard.similar_groups(d.limit(0)).count() == 0
    out = jaccard.one_of_each(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = {}
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {i: find(i) for e in edges for i in e if e[0] != e[1]}
    got = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {k: v for k, v in want.items()} and len(got) == len(want)


def test_prefix_length_adapts():
    assert jaccard.choose_length(np.array([1] * 40 + [2] * 60), 85) == 1
    assert jaccard.choose_length(np.array([500] * 100), 85) > 1
