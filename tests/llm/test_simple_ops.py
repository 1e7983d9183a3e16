"""Brute-force checks of operators 1, 2, 3, 5, 6 and 7."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomscope.llm import decontaminate, html, licences, quality, shards, topk


def brute_hits(text, items, window=10):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    hit, found = set(), set()
    for name, item in items:
        iw = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        for i in range(max(1, len(iw) - window + 1)) if iw else ():
            w = iw[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    found.add(name)
    return len(words), len(hit), sorted(found - {None})


def test_decontamination(spark):
    random.seed(5)
    pool = "a b c Dd é1 ñ 22".split()
    items = [(i, " ".join(random.choices(pool, k=random.randrange(0, 14)))) for i in range(30)] + [(30, None), (31, ""), (2, "a, B c"), (None, "22 22 é1 a")]
    docs = [(i, random.choice([" ", "-", ". "]).join(random.choices(pool, k=random.randrange(0, 60)))) for i in range(80)] + [(7, None), (8, ""), (None, "a b c " * 3000)]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    for most in (1 << 20, 40):
        got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b, most_bytes=most).collect()}
        want = set()
        for k, t in docs:
            n, h, names = brute_hits((t or "").encode(), [(None if i is None else str(i), x.encode()) for i, x in items if x], 10)
            want.add((k, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0))
        assert got == want
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_decontamination_spans_and_cuts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    text = "Öne, two! " + item.upper().replace(" ", ", ") + ". The rest stays here as it is, and it is long enough to be kept in the end."
    d = spark.createDataFrame([(1, text, "x", 5), (2, "clean", "x", 5), (3, item, "x", 5), (4, None, "x", None)], "doc_id long, text string, source string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    span = next(r.spans for r in decontaminate.contamination(d, b).collect() if r.doc_id == 1)
    assert text.encode()[span[0].start : span[0].stop].decode().lower().replace(", ", " ") == item
    for most in (1 << 20, 30):  # one scan, and several
        assert len(decontaminate.cut_passages(d, b, most_bytes=most).collect()) == 3
    out = {r.doc_id: r for r in decontaminate.cut_passages(d, b, most_bytes=30).collect()}
    assert out == {r.doc_id: r for r in decontaminate.cut_passages(d, b).collect()}
    assert set(out) == {1, 2, 4} and out[4].text is None and out[1].text.startswith("Öne, two! . The") and out[1].n_chars == len(out[1].text) and out[2].n_chars == 5


def test_top_k(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 0.2) for _ in range(20)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)] + [(7, rows[9][1]), (400, None), (None, rows[3][1]), (420, [float("nan")] * 20), (440, [0.5, -1.0]), (460, []), (40, rows[2][1]), ((1 << 63) - 1, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = list((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k=7, lanes=5, group=6, dims=4).collect())
    live = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v and not any(map(math.isnan, v))]
    want = []
    for own, (q, qv) in enumerate(live):
        if q is not None and q % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for k, (i, v) in enumerate(live) if k != own))[:7]
            want += [(q, r, None if null else i, -x) for r, (x, null, i) in enumerate(s, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    big = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 0.5]), (2, [3e7, 0.25]), (3, [1e18, 1.0])], "vec_id long, embedding array<double>")
    square = (64 * 30_000_000) ** 2  # beyond what doubles hold exactly
    assert [(r.vec_id, r.score) for r in topk.top_k(big, k=3).orderBy("rank").collect()] == [(3, (1 << 63) - 1), (1, square + 64 * 32), (2, square + 64 * 16)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_messages_equal_enumeration():
    model = html.Potentials(html.labelled_pages())
    trees = [html.parse(p) for p in ("<body><div class='ad'><p>Hi, you.</p></div><article><h1>T</h1></article></body>", "<p>a<p>b", "")]
    for t in trees:
        seen, n = html.observe(t), len(t.tags)
        total = np.zeros((n, 2))
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = model.root[y[0]] + sum(e[y[i], seen[i, f]] for i in range(n) for f, e in enumerate(model.emit)) + sum(model.pair[y[t.parent[i]], y[i]] for i in range(1, n))
            for i in range(n):
                total[i, y[i]] += math.exp(w)
        p = model.marginals(seen, np.array(t.parent), np.array(t.depth))
        assert np.allclose(p, total[:, 1] / total.sum(axis=1))


def test_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Tom &amp; Ann</h1><p><b>First,<br>line.<p>Second  &lt;one&gt;\n here, a bit longer.</p><script>x("</p>")</script><p>Yes.</article>
    <div class="comments"><div class="comment"><p>Nice read, thank you!</p></div></div><aside><p>Related things.</p></aside><footer>&copy; us</footer></body></html>"""
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, "u", "<article><p>" + "word, and more. " * 20000 + "</article>", "x")]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r for r in out}
    assert got[1].text == "Tom & Ann\n\nFirst, line.\n\nSecond <one> here, a bit longer.\n\nYes." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and len(out) == 5 and got[4].n_chars == 16 * 20000 - 1


def test_quality(spark):
    random.seed(1)
    good = [" ".join(random.choices("the of and into mild water stone bread".split(), k=40)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in random.choices("buy now free cash".split(), k=40)) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (None, good[0]), (0, good[0])]
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(d, lab).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 210]
    assert sum(r.predicted == int(r.doc_id < 150) for r in held) / len(held) > 0.95
    assert {r.score for r in quality.quality_scores(d, lab.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(d, d, lab)
    assert kept.columns == d.columns and 150 <= kept.count() <= 160


def test_shards(spark):
    random.seed(4)
    rows = [(i, "x" * random.randrange(0, 300)) for i in range(800)] + [(5000, "y" * 5000), (None, "z" * 150)] + [(9, "w" * 90)] * 40 + [(None, None)] * 3
    d = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, shard string")
    out = shards.extendible_shards(d, 2000).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes) for r in out) == sorted(((i is None, i or 0), len(t or "")) for i, t in rows)
    size, n = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        n[r.shard] = n.get(r.shard, 0) + 1
    assert all(b <= 2000 or n[s] == 1 for s, b in size.items())
    assert all(r.shard_bytes == size[r.shard] and r.oversize == (r.n_bytes > 2000) for r in out)
    names = sorted(size)
    assert not any(b.startswith(a) and a != b for a in names for b in names)
    assert shards.extendible_shards(d.limit(0), 10).count() == 0


def test_licences(spark):
    pad = "plain words of no note at all, told at length. " * 40
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a.txt", pad), (3, "p/q/r/b.txt", pad), (4, "p/q/c.txt", "Licensed under the Apache License, Version 2.0.\n" + pad),
        (5, "o/d.txt", pad), (6, "p/q/x/COPYING", "Licensed under CC BY-NC 4.0.\n" + pad), (7, "p/q/x/y/e.txt", None), (8, None, "GNU General Public License, version 3. This work is licensed under the"), (9, "p", ""), (9, "p", ""),
    ]
    d = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, path string, text string, licence string")
    out = licences.scan(d).collect()
    got = {r.file_id: (r.licence, r.origin, r.from_directory) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("MIT", "licence file", None) and got[2] == ("MIT", "directory", "p") and got[3] == ("MIT", "directory", "p")
    assert got[4] == ("Apache-2.0", "header", None) and got[5] == (None, None, None) and got[6][:2] == ("CC-BY-NC-4.0", "licence file")
    assert got[7] == ("CC-BY-NC-4.0", "directory", "p/q/x") and got[8][0] == "GPL-3.0" and got[9] == (None, None, None)
    assert licences.scan(d.limit(0)).count() == 0


def test_template_frequency_equals_brute(spark):
    d = spark.createDataFrame([(1, "a", "Apache license apache"), (2, "b", "no LICENSE"), (3, "c", None)], "file_id long, path string, text string")
    n, held = licences.document_frequency(d)
    assert n == 3 and held[b"license"] == 2 and held[b"apache"] == 1


def test_licence_lines_match_in_corpora_of_any_size():
    lines = [
        (b"// Licensed under the Apache License, Version 2.0 by Acme Corp.", "Apache-2.0"), (b"# Released under the MIT License by Foo.", "MIT"),
        (b"Licensed under the Apache License, Version 2.0. See LICENSE.", "Apache-2.0"), (b"Licensed under CC BY-NC 4.0. Contact Acme.", "CC-BY-NC-4.0"),
    ]
    share = {b"the": 0.5, b"by": 0.3, b"under": 0.1, b"version": 0.02, b"released": 0.01}
    got = []
    for n in (1_000, 10_000, 6_000_000):
        m = licences.Matcher(n, {t: int(n * share.get(t, 0.002)) for t in licences.VOCABULARY})
        got.append([m.scan(line, 0.7)[:2] for line, _ in lines])
        assert [name for name, _ in got[-1]] == [name for _, name in lines]
        assert m.scan(b"You need a permission slip to park a car under the bridge by the river", 0.7)[0] is None
    assert got[0] == got[1] == got[2]


def test_licence_notices_over_many_lines():
    m = licences.Matcher(1000, dict.fromkeys(licences.VOCABULARY, 10))
    notice = licences.TEMPLATES["BSD-3-Clause"][0].split()
    for width in (20, 7, 5, 4, 2, 1):
        text = "\n".join("# " + " ".join(notice[k : k + width]) for k in range(0, len(notice), width))
        assert m.scan(f"# Some words stand here\n#\n{text}\n#\nimport x".encode(), 0.7)[:2] == ("BSD-3-Clause", pytest.approx(1.0))


def test_licence_windows_equal_brute():
    random.seed(9)
    for _ in range(200):
        n = random.randrange(1, 12)
        size = [random.randrange(1, 20) for _ in range(n)]
        i = random.randrange(n)
        want = {(a, b) for a in range(i + 1) for b in range(i + 1, n + 1) if b - a <= 2 or sum(size[a + 1 : b - 1]) + 2 <= licences.LONGEST}
        got = list(licences._windows(i, n, size.__getitem__))
        assert len(got) == len(set(got)) and set(got) == want


def test_licence_index_loses_nothing(spark):
    """Results through Spark against all windows of all lines, each compared with every template."""
    random.seed(11)
    notices = [x for texts in licences.TEMPLATES.values() for x in texts]
    texts = ["", None, "Licence\n" * 3]
    for _ in range(150):
        lines = [" ".join(random.choices("stone river of the to licensed version under public source".split(), k=random.randrange(1, 9))) for _ in range(4)]
        words = random.choice(notices).split()
        for _ in range(random.randrange(3)):
            words.pop(random.randrange(len(words)))
        cut = random.randrange(len(words) + 1)
        lines[2:2] = [" ".join(words[:cut]), " ".join(words[cut:])]
        texts.append("\n".join(lines))
    d = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "file_id long, path string, text string")
    got = {r.file_id: (r.own, r.cosine) for r in licences.detect(d).collect()}
    m = licences.Matcher(*licences.document_frequency(d))
    hit = 0
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").encode().split(b"\n") if x.strip()]
        size = [max(1, licences.terms(x).total()) for x in lines]
        best = (0.0, None)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if b - a > 2 and sum(size[a + 1 : b - 1]) + 2 > licences.LONGEST:
                    continue
                v = m.vector(licences.terms(b"\n".join(lines[a:b])))
                norm = math.sqrt(sum(w * w for w in v.values()))
                for row, name, own in zip(m.notices.rows, m.notices.names, m.notices.own, strict=True):
                    if not own or own & v.keys():
                        best = max(best, (sum(w * v.get(k, 0) for k, w in row.items()) / norm, name), key=lambda x: round(x[0], 9))
        assert got[i][0] == (best[1] if best[0] >= 0.7 else None) or abs(best[0] - 0.7) < 1e-9, (i, t, best, got[i])
        assert got[i][1] is None or got[i][1] == pytest.approx(best[0], abs=1e-5)
        hit += got[i][0] is not None
    assert 50 < hit < len(texts)


def test_licences_and_their_relatives():
    m = licences.Matcher(1000, dict.fromkeys(licences.VOCABULARY, 10) | {b"the": 900, b"under": 200, b"of": 900})
    for line, name in [
        ("This library is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Not released under the MIT License.", None), ("Released under the Foo License.", None), ("Licensed under the Foo License.", None),
        ("Not licensed under the Apache License, Version 2.0. Released under the MIT License.", "MIT"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD-3-Clause"),
    ]:
        assert m.scan(line.encode(), 0.7)[0] == name, line
    for name, text in licences.FULL.items():
        words = f"Copyright (c) 2020, Ann Example. All rights reserved. {text}".split()
        got = m.scan("\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11)).encode(), 0.7)
        assert got[0] == name and got[1] > 0.9 and got[4] > 0, (name, got)
    long = ("word under the law " * 50 + "\n") * 2000
    assert m.scan(f"{long}Released under the MIT License.\n{long}".encode(), 0.7)[:3] == ("MIT", pytest.approx(1.0), 1)


def test_extraction_of_other_layouts():
    """Layouts in which parts of other kinds are inside the article, and what is hidden."""
    model = html.Potentials(html.labelled_pages())
    shared = "<body><article><h1>Bread</h1><p>Flour, water and salt are all it takes, and some hours of time.</p><div class='share'><a href=/f>Share</a></div><p>Bake it until it is brown, then let it rest.</p><aside><ul><li><a href=/1>Cake</a></li></ul></aside></article></body>"
    noted = "<body><article><h1>Notes</h1><p>The first edition was printed in 1840, the second ten years later.</p><p class='footer-note'>Both are in the town's library.</p></article></body>"
    hidden = "<body><article><p>Shown, as it should be, to all.</p><p hidden>Not shown.</p><p class='a hidden'>A small town, by a lake.</p><p title=' hidden '>Where <math><mi>x</mi></math> is small.</p></article></body>"
    got = html.extract([shared, noted, hidden], model)
    assert got[0] == "Bread\n\nFlour, water and salt are all it takes, and some hours of time.\n\nBake it until it is brown, then let it rest."
    assert got[1].endswith("later.\n\nBoth are in the town's library.")
    assert got[2] == "Shown, as it should be, to all.\n\nA small town, by a lake.\n\nWhere x is small."
