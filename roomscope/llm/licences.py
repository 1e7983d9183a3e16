"""License scans (operator 2).

Lines of each file's whole text are compared with licence templates by the cosine of sparse TF-IDF vectors. Weights of terms come
from all files: the share of them that holds each template term. No share counts as less than RAREST, and words outside the
templates weigh as much as the rarest template term that is found, so that a line's cosine doesn't depend on the number of files.
A line, or adjacent ones up to the length of the longest template, at ``threshold`` or more of a template names that licence; the
best match of the file is its own licence. A file that as a whole is that near to the full text of a licence has that one. A licence
file (by its name, or because licence lines make up half of its words) also names its directory's licence; files without one of
their own take that of the nearest ancestor directory that has one, by equi-joins of directory paths.

An index of terms finds what to compare, and loses nothing: by Cauchy-Schwarz the cosine is at most the root of the squared weight
of the template's terms that are there, so what reaches ``threshold`` holds one of the template's heaviest terms, those without
which the rest has too little weight. Templates with terms that no other licence's templates have match only what holds one of them
("released under the Foo License" is not MIT), and clauses that deny a licence ("not licensed under ...") are not read.

Templates are a fixed list and so is the set of terms; what grows with the corpus is only ever joined or summed. Directories are
resolved once each, not once for each file. Null texts and empty texts have no licence of their own; a null path has no
directory. Ties of templates go to the first name. Repeated rows give repeated rows. Very long texts are read whole; lines far from
any of the index's terms cost one pass over their words. Only file_id, path and text are read, further columns of any name are not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

_SPDX = "SPDX-License-Identifier: "
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."


def _gnu(name: str, version: str, spdx: str, day: str) -> list[str]:
    plain = f"GNU {name} as published by the Free Software Foundation"
    return [
        f"This work is licensed under the GNU {name}, version {version}.", _GNU.format(name, version), f"{plain}, version {version}.", f"{_SPDX}{spdx}-or-later", f"{_SPDX}{spdx}-only", f"GNU {name} Version {version}, {day}",
    ]


def _cc(short: str, long: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"{_SPDX}CC-{short}-4.0"]


#: Short notices and the opening words of well-known licences.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.", "The MIT License (MIT)"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", *_gnu("General Public License", "3", "GPL-3.0", "29 June 2007")],
    "GPL-2.0": _gnu("General Public License", "2", "GPL-2.0", "June 1991"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPL-3.0", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "LGPL-2.1", "February 1999"),
    "AGPL-3.0": _gnu("Affero General Public License", "3", "AGPL-3.0", "19 November 2007"),
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "Simplified BSD License"],
    "ISC": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
#: Whole texts of the licences that are short enough to be one.
FULL: dict[str, str] = {
    "BSD-2-Clause": f"{_BSD} {_WARRANTY}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY}",
    "ISC": """ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
_TERM = re.compile(rb"[a-z0-9]+(?:[.-][0-9]+)*")
#: A clause that says that a licence does not hold.
_DENIED = re.compile(rb"\b(?:not|never|no longer)\s+(?:\w+\s+)?(?:released|licensed|distributed|available|covered|governed|published)\b[^;\n]*?(?:\.(?![0-9])|;|$)", re.I | re.M)
NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"


def terms(text: bytes) -> Counter:
    return Counter(_TERM.findall(text.lower()))


#: A term that fewer files hold weighs as if this share of them did: what a large corpus has of rare words says no more than that.
RAREST = 1e-3
VOCABULARY = sorted({t for texts in (*TEMPLATES.values(), FULL.values()) for x in texts for t in terms(x.encode())})


#: Terms of the longest template.
LONGEST = max(terms(x.encode()).total() for texts in TEMPLATES.values() for x in texts)
#: Lines without it are borders of comments and the like.
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]")


def _windows(i: int, n: int, size: Callable[[int], int]) -> Iterator[tuple[int, int]]:
    """Ranges of adjacent lines with line i in them: one, two, and all in which a text of LONGEST terms can begin in the first and end in the last."""
    a, before = i, 0  # before: terms of the lines between the first and line i
    while a >= 0 and (a >= i - 1 or before + 2 <= LONGEST):
        b, inner = i + 1, before + (size(i) if a < i else 0)
        yield a, b
        while b < n and (b - a == 1 or inner + 2 <= LONGEST):
            b += 1
            yield a, b
            inner += size(b - 1)
        if a < i:
            before += size(a)
        a -= 1


def document_frequency(files: DataFrame) -> tuple[int, dict[bytes, int]]:
    """How many files hold each template term, over all files: one row per batch is summed, one per term comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(VOCABULARY)
        count: Counter = Counter()
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                if t:
                    count.update(wanted.intersection(_TERM.findall(t.lower())))
        names = ["", *(t.decode() for t in count)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n, *count.values()], pa.int64())], names=["term", "n"])

    rows = files.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return found.pop("", 0), {t.encode(): n for t, n in found.items()}


class Vectors:
    """Weighted texts of licences, and which of them hold a term."""

    def __init__(self, texts: list[tuple[str, str]], weight: Callable[[bytes], float], own: bool):
        self.names = [name for name, _ in texts]
        self.rows: list[dict[bytes, float]] = []
        for _, x in texts:
            v = {t: (1 + math.log(c)) * weight(t) for t, c in terms(x.encode()).items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            self.rows.append({t: w / norm for t, w in v.items()})
        self.holds: dict[bytes, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.rows):
            for t, w in v.items():
                self.holds.setdefault(t, []).append((k, w))
        owners = {t: {self.names[k] for k, _ in rows} for t, rows in self.holds.items()}
        self.own = [{t for t in v if len(owners[t]) == 1} if own else set() for v in self.rows]

    def heaviest(self, threshold: float) -> set[bytes]:
        """Terms of which a text at ``threshold`` or more of one of the vectors has at least one."""
        out = set()
        for v in self.rows:
            left = 1.0
            for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
                if left < threshold * threshold - 1e-9:
                    break
                out.add(t)
                left -= w * w
        return out

    def reach(self, found: set[bytes]) -> float:
        """The most squared weight that any vector has in these terms."""
        mass = [0.0] * len(self.rows)
        for t in found:
            for k, w in self.holds.get(t, ()):
                mass[k] += w * w
        return max(mass)

    def nearest(self, v: dict[bytes, float]) -> tuple[float, str, float]:
        """Cosine and licence of the nearest vector, and the cosine of the nearest of any other licence."""
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        score = [0.0] * len(self.rows)
        for t, w in v.items():
            for k, x in self.holds.get(t, ()):
                score[k] += w * x
        best: dict[str, float] = {}
        for name, own, x in zip(self.names, self.own, score, strict=True):
            x = round(x / norm, 12) if not own or not own.isdisjoint(v) else 0.0
            best[name] = max(best.get(name, 0.0), x)
        name = min(best, key=lambda k: (-best[k], k))
        return best[name], name, max((x for k, x in best.items() if k != name), default=0.0)


class Matcher:
    def __init__(self, n: int, held: dict[bytes, int]):
        found = {t: 1.0 - math.log(max(held[t] / n, RAREST)) for t in VOCABULARY if held.get(t)}
        self.rare = max(found.values(), default=1.0 - math.log(RAREST))  # a term of no template, or of no file
        self.idf = {t: found.get(t, self.rare) for t in VOCABULARY}
        self.notices = Vectors([(name, x) for name, texts in sorted(TEMPLATES.items()) for x in texts], self.idf.__getitem__, own=True)
        self.texts = Vectors(sorted(FULL.items()), self.idf.__getitem__, own=False)
        self._first: dict[float, set[bytes]] = {}

    def first(self, threshold: float) -> set[bytes]:
        """The terms one of which whatever reaches ``threshold`` holds."""
        if threshold not in self._first:
            self._first[threshold] = self.notices.heaviest(threshold) | self.texts.heaviest(threshold)
        return self._first[threshold]

    def vector(self, counts: Counter) -> dict[bytes, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.rare) for t, c in counts.items()}

    def nearest(self, counts: Counter) -> tuple[float, str, float]:
        return self.notices.nearest(self.vector(counts))

    def whole(self, text: bytes, found: set[bytes], threshold: float) -> tuple[float, str, float] | None:
        """The licence whose full text the whole file is near to."""
        if self.texts.reach(found) < threshold * threshold - 1e-9:
            return None
        got = self.texts.nearest(self.vector(terms(text)))
        return got if got[0] >= threshold else None

    def scan(self, text: bytes, threshold: float) -> tuple[str | None, float, int, int, float]:
        """Licence, its cosine, licence lines, words in them, and how far the next licence's cosine is below."""
        first = self.first(threshold)
        found = set(_TERM.findall(text.lower()))
        if first.isdisjoint(found):
            return None, 0.0, 0, 0, 0.0
        text = _DENIED.sub(b"", text)
        lines = [x for x in text.split(b"\n") if _WORD.search(x)]
        if got := self.whole(text, found, threshold):
            return got[1], got[0], len(lines), len(text.split()), got[0] - got[2]
        known: dict[int, Counter] = {}
        seen: dict[tuple[int, int], tuple[float, str, float]] = {}

        def of(i: int) -> Counter:
            if i not in known:
                known[i] = terms(lines[i])
            return known[i]

        def size(i: int) -> int:
            return max(1, of(i).total())

        def match(a: int, b: int) -> tuple[float, str, float]:
            if (a, b) not in seen:
                seen[a, b] = self.nearest(sum((of(k) for k in range(a + 1, b)), of(a)))
            return seen[a, b]

        def around(i: int) -> set[bytes]:
            """Terms of all lines that are in a window with line i."""
            out = set(of(i))
            for step in (-1, 1):
                k, inner = i + step, 0
                while 0 <= k < len(lines) and (k == i + step or inner + 2 <= LONGEST):
                    out |= of(k).keys()
                    inner += size(k)
                    k += step
            return out

        top, name, hits, words, margin = 0.0, None, 0, 0, 0.0
        for i, line in enumerate(lines):
            if first.isdisjoint(of(i)) or self.notices.reach(around(i)) < threshold * threshold - 1e-9:
                continue
            got = max((match(a, b) for a, b in _windows(i, len(lines), size)), key=lambda x: x[0])
            if got[0] >= threshold:
                hits += 1
                words += len(line.split())
                if got[0] > top:
                    top, name, margin = got[0], got[1], got[0] - got[2]
        return name, top, hits, words, margin


def detect(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``files`` (file_id, path, text): path, own licence, cosine and how far the next licence is below, licence lines, whether a licence file."""
    held = files.sparkSession.sparkContext.broadcast(Matcher(*document_frequency(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, tops, hits, half, margins = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                name, top, n, words, margin = held.value.scan(t or b"", threshold)
                names.append(name)
                tops.append(round(top, 6) if name else None)
                hits.append(n)
                margins.append(round(margin, 6) if name else None)
                half.append(bool(name) and 2 * words >= len((t or b"").split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(hits, pa.int64()), pa.array(half), pa.array(margins, pa.float64())], names=["file_id", "path", "own", "cosine", "n_lines", "mostly", "margin"])

    rows = files.select(F.col("file_id").cast("long"), "path", F.col("text").cast("binary").alias("text")).mapInArrow(run, "file_id long, path string, own string, cosine double, n_lines long, mostly boolean, margin double")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return rows.withColumn("directory", directory).withColumn("is_licence_file", F.col("own").isNotNull() & (F.col("mostly") | F.coalesce(F.col("path").rlike(NAMED), F.lit(False)))).drop("mostly")


def scan(files: DataFrame, threshold: float = 0.7) -> DataFrame:
    """detect() and inheritance: file_id, path, licence, origin ('header', 'licence file', 'directory' or null), from_directory, cosine, margin, n_lines."""
    found = settle(detect(files, threshold))
    named = found.where("is_licence_file and path is not null").groupBy("directory").agg(F.min_by("own", F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("o"))).alias("licence"))
    places = found.where("path is not null").select("directory").distinct()
    steps = F.split("directory", "/")
    above = places.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).withColumn("ancestor", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(named.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max_by("licence", "depth").alias("inherited"), F.max_by("ancestor", "depth").alias("from_directory"))
    out = found.join(nearest, "directory", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "file_id", "path", F.coalesce("own", "inherited").alias("licence"),
        F.when(own & F.col("is_licence_file"), "licence file").when(own, "header").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
        F.when(~own, F.col("from_directory")).alias("from_directory"), "cosine", "n_lines", "margin",
    )
