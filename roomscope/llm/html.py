"""Main-text extraction from web pages (operator 5).

A page becomes a DOM tree by a tolerant one-pass tokeniser. The tree is a graphical model: each element has a hidden state, content
or boilerplate; its tag, the words in its class, id and role, its share of link text, its amount of text and its punctuation are
observed; a potential connects each parent's state with its child's. Sum-product messages go from the leaves up and from the root
down, for all pages of a batch at once, level by level, and give every element's exact marginal. Potentials are smoothed counts
over labelled pages. Text whose element is more likely content than not makes up the result.

Blocks (paragraphs, headings, list items, cells and so on) are joined by an empty line; white space inside a block is one space;
character references are decoded. Scripts, styles, templates, comments, the head and elements with ``hidden`` hold no text. Null and empty pages give an
empty text. Pages are independent, so repeated rows repeat; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|\Z)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe select option".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary"}
#: An opening tag ends these open ones, up to a boundary.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "button", "label", "b", "i", "span", "br", "code")
GROUPS = {
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion",
    "comment": "comment comments disqus reply replies respond discussion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip",
    "frame": "header footer masthead copyright legal foot head top bottom",
    "side": "sidebar side aside related widget recommended popular trending more share social sharing newsletter subscribe signup login",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning dialog",
    "body": "article content post entry main story text body paragraph blog",
}
_GROUP = {w: g for g, words in GROUPS.items() for w in words.split()}
GROUP_NAMES = ("none", *GROUPS)
#: Observed fields of an element and how many values each has: tag, class group, link share, text, sentence marks.
SIZES = (len(TAGS) + 1, len(GROUP_NAMES), 4, 5, 3)
_TAG = {t: i for i, t in enumerate(TAGS)}
_TAG |= {"h4": _TAG["h3"], "h5": _TAG["h3"], "h6": _TAG["h3"], "strong": _TAG["b"], "em": _TAG["i"], "th": _TAG["td"], "input": _TAG["form"], "select": _TAG["form"], "hgroup": _TAG["header"]}


class Tree:
    """Elements in page order (parents before children) and the text runs between them."""

    __slots__ = ("attrs", "depth", "hidden", "parent", "runs", "tags")

    def __init__(self) -> None:
        self.tags: list[str] = ["html"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.hidden: list[bool] = [False]
        self.runs: list[tuple[int, int, str]] = []  # element, number of the block, decoded text


def parse(page: str) -> Tree:
    t = Tree()
    stack, block, at, n = [0], 0, 0, len(page)
    tags, runs = t.tags, t.runs

    def text(upto: int) -> None:
        if upto > at:
            s = page[at:upto]
            runs.append((stack[-1], block, entities.unescape(s) if "&" in s else s))

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if tags[stack[i]] in names:
                del stack[i:]
                return
            if tags[stack[i]] in stop:
                return

    for m in iter(lambda: _TOKEN.search(page, at), None):
        text(m.start())
        at = m.end()
        if name := m["open"]:
            name = name.lower()
            if name in CLOSES_P:
                close({"p"}, {"table", "td", "th", "li", "button", "article", "section", "div", "blockquote", "aside", "nav", "header", "footer", "form", "main"})
            if name in ENDS:
                close(*ENDS[name])
            if name in BLOCK:
                block += 1
            if name == "html":
                continue
            attrs = m["attrs"] or ""
            self_closed = attrs.endswith("/") and name not in BLOCK
            if name in RAW:
                if not self_closed:
                    end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if name == "br":
                runs.append((stack[-1], block, " "))
            if name in VOID:
                continue
            tags.append(name)
            t.attrs.append(attrs)
            t.parent.append(stack[-1])
            t.depth.append(t.depth[stack[-1]] + 1)
            t.hidden.append(t.hidden[stack[-1]] or name == "head" or ("hidden" in attrs.lower() and bool(_HIDDEN.search(_QUOTED.sub(" ", attrs)))))
            if not self_closed:
                stack.append(len(tags) - 1)
        elif name := m["close"]:
            name = name.lower()
            if name in BLOCK:
                block += 1
            if name not in ("html", "body"):
                close({name}, frozenset())
        elif m["cdata"]:
            runs.append((stack[-1], block, m["cdata"]))
    text(n)
    return t


def _group(tag: str, attrs: str) -> int:
    if not attrs:
        return 0
    seen = [g for m in _ATTR.finditer(attrs) for w in _WORD.findall(m[2] or m[3] or m[4] or "") if (g := _GROUP.get(w.lower()))]
    for g in ("advert", "comment", "notice", "menu", "side", "frame", "body"):
        if g in seen:
            return GROUP_NAMES.index(g)
    return 0


def observe(t: Tree) -> np.ndarray:
    """One row of observed values per element; amounts are over the element's whole subtree."""
    n = len(t.tags)
    size, links, marks = [0] * n, [0] * n, [0] * n
    for e, _, s in t.runs:
        k = len(s.strip())
        size[e] += k
        marks[e] += s.count(".") + s.count(",") + s.count("?") + s.count("!")
    for e in range(n):
        if t.tags[e] == "a":
            links[e] = size[e]
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        size[p] += size[e]
        marks[p] += marks[e]
        links[p] += size[e] if t.tags[e] == "a" else links[e]
    out = np.empty((n, len(SIZES)), dtype=np.int8)
    for e in range(n):
        share = (1.0 if t.tags[e] == "a" else links[e] / size[e]) if size[e] else 0.0
        out[e] = (
            _TAG.get(t.tags[e], len(TAGS)), _group(t.tags[e], t.attrs[e]), 0 if share < 0.05 else 1 if share < 0.35 else 2 if share < 0.8 else 3,
            0 if not size[e] else 1 if size[e] < 25 else 2 if size[e] < 100 else 3 if size[e] < 400 else 4, min(2, marks[e]),
        )
    return out


class Potentials:
    """Log potentials: of each observed value given the state, of a child's state given its parent's, of the root's."""

    def __init__(self, pages: list[tuple[Tree, list[int]]], smooth: float = 0.5):
        emit = [np.full((2, k), smooth) for k in SIZES]
        pair, root = np.full((2, 2), smooth), np.array([1.0, smooth])
        for t, labels in pages:
            y = np.array(labels)
            seen = observe(t)
            for f, table in enumerate(emit):
                np.add.at(table, (y, seen[:, f]), 1)
            parent = np.array(t.parent)
            np.add.at(pair, (y[parent[1:]], y[1:]), 1)
            root[y[0]] += 1
        # Counts of one element's fields are not independent: each gets part of its weight.
        self.emit = [w * np.log(x / x.sum(axis=1, keepdims=True)) for w, x in zip((1.0, 1.5, 0.5, 0.35, 0.35), emit, strict=True)]
        self.pair = np.log(pair / pair.sum(axis=1, keepdims=True))
        self.root = np.log(root / root.sum())

    def marginals(self, seen: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """P(content) of each element of a forest, by sum-product over its levels. Roots have parent -1."""
        own = sum(table[:, seen[:, f]] for f, table in enumerate(self.emit)).T
        up = own.copy()
        order = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
        message = np.zeros_like(own)
        for level in order[:0:-1]:
            message[level] = np.logaddexp(self.pair[:, 0] + up[level, :1], self.pair[:, 1] + up[level, 1:])
            np.add.at(up, parent[level], message[level])
        belief = up.copy()
        if order:
            belief[order[0]] += self.root
        for level in order[1:]:
            rest = belief[parent[level]] - message[level]  # the parent without what this child told it
            rest -= rest.max(axis=1, keepdims=True)
            belief[level] += np.logaddexp(self.pair[0] + rest[:, :1], self.pair[1] + rest[:, 1:])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


# ---- labelled pages --------------------------------------------------------------------------------------------------------


def labelled_pages() -> list[tuple[Tree, list[int]]]:
    """Pages written for training, marked by hand: in the layouts below, [[ and ]] enclose the elements that are content."""
    long = "The valley had been quiet for years, and few people came by. Then the railway was built, the mill opened again, and within a decade there were three schools. " * 2
    mid = "Nobody could say who had first planted the orchard, but it was old. "
    junk = "Das### ist&&& ein%%% Text*** mit$$$ vielen### Zeichen&&& darin"
    heads = ["Old valley", "A short history of the mill and of those who ran it", "What remains?", "Der alte Garten"]
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home About News Contact".split())
    tops = [
        f"<nav><ul>{links}</ul></nav>", f'<header><h1>The Daily Example</h1><nav><ul>{links}</ul></nav></header>', f'<div class="menu"><ul>{links}</ul></div>',
        f'<div id="header"><a href="/">Home</a><p>Your local paper, every day.</p></div><div class="nav-bar"><a href="/a">A</a> <a href="/b">B</a></div>',
    ]
    ads = ['<div class="ad">Buy one, get one for free. Only today at the market.</div>', f'<div class="sponsored-post"><p>{mid}</p></div>', '<div class="cookie-notice"><p>We use cookies to improve this site. <button>Accept</button></p></div>', '<aside class="banner"><p>Subscribe now and save half.</p></aside>', '<div class="ad">Sale.</div>']
    sides = [f'<aside><h3>Related</h3><ul>{links}</ul></aside>', f'<div class="sidebar"><h3>Popular</h3><p>{mid}</p><ul>{links}</ul></div>', '<form action="/q"><label>Search</label><input name="q"><button>Go</button></form>', '<section class="newsletter"><form><p>Get our letter every week.</p><input></form></section>', ""]
    talk = ['<div class="comments"><h3>Comments</h3><div class="comment"><p>I grew up there, what a lovely piece. Thank you!</p></div><div class="comment"><p>Great.</p></div></div>', '<section id="comments"><article class="comment"><p>I do not agree, and here is why it is wrong.</p></article><ul><li>Me too.</li></ul></section>', ""]
    feet = ["<footer>&copy; example.org &middot; All rights are reserved by us.</footer>", f'<div class="footer"><ul>{links}</ul><p>Imprint. Contact. {mid}</p></div>', "<footer><p>Copyright by the authors, and others.</p></footer>"]
    out = []
    bodies = []
    for h in heads:
        bodies += [
            f"[[<article><h1>{h}</h1><p><b>{h}.<br><p>{long}</p><p>{mid}</p><p>Yes.</p></article>]]",
            f"[[<article><h1>{h}</h1><p>{junk}</p><p>{junk} {junk}</p></article>]]",
            f'<main>[[<article class="post"><h1>{h}</h1><p>{long}</p><h2>{h}</h2><ul><li>{mid}</li><li>Stone</li></ul><blockquote><p>{mid}</p></blockquote><table><tr><td>1880</td><td>Mill</td></tr></table></article>]]</main>',
            f'<div class="content">[[<div class="article-body"><h2>{h}</h2><p>{mid}<a href="/x">more on it</a> and <i>so on</i>.</p><p>{long}</p><pre>a b</pre></div>]]</div>',
            f"<main>[[<section><h1>{h}</h1><p>{long}</p></section>]]</main>",
            f"[[<article><h1>{h}</h1><p>{h}.</p></article>]]",
            f"[[<article><h1>{h}</h1><p>{' | '.join(mid.split())}</p><p>{mid.upper()}</p><figure><figcaption>{h}</figcaption></figure></article>]]",
        ]
    for i, body in enumerate(bodies):
        for k in range(4):
            j = i + 3 * k
            layout = f"<body>{tops[j % 4]}<!-- x -->{ads[j % 5]}{body}{talk[j % 3]}{sides[(j + k) % 5]}{feet[(j + k) % 3]}</body>"
            if k % 2:
                layout = f'<body><div class="page">{layout[6:-7]}</div></body>'
            out.append(_label(layout))
    foot = '<div class="share-buttons"><a href="/f">Share</a> <a href="/t">Post</a></div>'
    cited = f'<p>{mid}See <a href="/a">the mill</a> and <a href="/b">the orchard</a>, both of them old.</p>'
    for h in heads:
        inner = [
            f"<h1>{h}</h1>{cited}<p><a href='/c'>The whole list of the valley's mills and their owners</a></p><p>{long}</p>",
            f"<h1>{h}</h1><p>{long}</p>]]{foot}[[<p>{mid}</p>]]<aside><h3>Related</h3><ul>{links}</ul></aside>[[",
            f'<h2>{h}</h2><p>{mid}</p><p>{long}</p><p class="footer-note">{mid}</p>',
            f"<h1>{h}</h1><table><tr><th>Year</th><th>Mills</th></tr><tr><td>1880</td><td>3</td></tr></table><ul><li>{mid}</li><li>Iron</li></ul><p>{mid}</p>",
        ]
        for k, x in enumerate(inner):
            out.append(_label(f"<body>{tops[k]}[[<article>{x}</article>]]{feet[k % 3]}</body>"))
            out.append(_label(f"<body>{tops[3 - k]}[[<main>{x}</main>]]{sides[k]}{feet[(k + 1) % 3]}</body>"))
        out.append(_label(f"[[<body><p>{long}</p><p>{mid}</p></body>]]"))
        out += [_label(f"[[<p>{mid}</p><p>{mid}</p>]]"), _label(f"[[<h1>{h}</h1><p>{long}</p><p>{mid}</p>]]")]
        out.append(_label(f"<body>{tops[0]}[[<article><h1>{h}</h1>{cited}<p><a href='/c'>The whole list of the valley's mills and their owners</a></p></article>]]</body>"))
        out.append(_label(f"<body>[[<article><h1>{h}</h1><p>{mid}</p>]]{foot}[[<p>{mid}</p>]]<aside><ul>{links}</ul></aside>[[</article>]]</body>"))
        out.append(_label(f"[[<body><h1>{h}</h1><p>{long}</p><p>{cited}</p></body>]]"))
    return out


def _label(layout: str) -> tuple[Tree, list[int]]:
    """A tree and its states: an element is content if it opens between the marks."""
    opened = re.sub(r"\[\[|\]\]", "", layout)
    flags, inside, i = [], False, 0
    while i < len(layout):
        if layout.startswith(("[[", "]]"), i):
            inside = layout[i] == "["
            i += 2
            continue
        m = _TOKEN.match(layout, i) if layout[i] == "<" else None
        if m and m["open"] and m["open"].lower() not in VOID | RAW | {"html"}:
            flags.append(int(inside))
        i = m.end() if m else i + 1
    return parse(opened), [0, *flags]


def extract(pages: list[str | None], model: Potentials) -> list[str]:
    """The main texts of a batch of pages: one pass of messages over the forest of their trees."""
    trees = [parse(p or "") for p in pages]
    starts = np.cumsum([0, *(len(t.tags) for t in trees)])
    parent = np.concatenate([np.array(t.parent) + s * (np.array(t.parent) >= 0) for t, s in zip(trees, starts, strict=False)])
    likely = model.marginals(np.concatenate([observe(t) for t in trees]), parent, np.concatenate([np.array(t.depth) for t in trees]))
    out = []
    for t, s in zip(trees, starts, strict=False):
        p = likely[s : s + len(t.tags)].tolist()
        blocks: list[list[str]] = []
        at = None
        for e, block, text in t.runs:
            if t.hidden[e] or p[e] <= 0.5:
                continue
            if block != at:
                blocks.append([])
                at = block
            blocks[-1].append(text)
        flat = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n\n".join(b for b in flat if b))
    return out


def main_texts(pages: DataFrame, model: Potentials | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or Potentials(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract(part.column(2).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
