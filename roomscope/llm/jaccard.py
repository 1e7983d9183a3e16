"""Similarity join of word n-gram sets by Jaccard, with adaptive multi-match prefixes (operator 4).

Two documents link if 100 * intersection >= percent * union of their sets. For a global order of tokens, two such sets share at
least l tokens within the first n - ceil(percent * n / 100) + l of each, for any l: a longer prefix asks for more shared tokens.

1. In hash order, with l a tenth of the set, documents tell hash shards their prefix tokens and learn how many of them another
   document has. Who has too few can't link and is done; most documents are. (Equal sets always pass.)
2. The others' distinct sets learn how many sets hold each token and order their tokens from the rarest on. Each set lengthens
   its prefix as far as that is estimated to save more verifying than the further tokens cost in candidates.
3. In a token's list the most central set (fewest tokens of its own) is compared with the rest: a star instead of all pairs.
   Verified links give components, and only pairs across components that share the asked number of prefix tokens at places that
   still allow the overlap are verified as well. A pair inside one component needs no verifying to know the components.

All pairs that could link across components are verified by their whole sets, so no link that joins components is lost. Null
texts and texts without words have empty sets and link with nothing. Equal sets (copies) link and are compared as one. Rows that
repeat an id count each by itself; null ids are no component's smallest id unless it has no other. Shingles are equal if their
64-bit hashes are, sets if 63 bits of theirs. Texts of any length are read whole; an empty table gives an empty result; other columns
aren't read, so their names can't clash. Ties in a token's frequency go by the token's hash, in a star's centre by the set's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import PACKED, Blocks, by_shard, join_packed, pack, packed_batch, shard_of, unpack
from .common import LOWER, U, mix, release, settle, word_hashes
from .graphs import components

_M = U(0x9E3779B97F4A7C15)
_CHUNK = 1_900_000
_LAST = (1 << 63) - 1
#: Rows of two numbers at most that are broadcast.
MOST_BROADCAST = 1_000_000


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``words`` words, or of all its words if it has fewer."""
    h, counts = word_hashes([t.translate(LOWER) for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        w = h[at : at + n]
        at += n
        if n >= words:
            s = w[: n - words + 1].copy()
            for i in range(1, words):
                s = s * _M + w[i : n - words + 1 + i]
            s = np.unique(mix(s))
        elif n:
            s = U(n)
            with np.errstate(over="ignore"):
                for x in w:
                    s = s * _M + x
            s = mix(np.array([s ^ U(0xA5A5A5A5A5A5A5A5)], dtype=np.uint64))
        else:
            s = w[:0]
        out.append(s)
    return out


def _texts(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int | None], list[bytes]]]:
    """Stretches of at most about _CHUNK bytes: block, rows, ids, texts."""
    cols = [table.column(table.schema.get_field_index(c)) for c in ("block", "row", "doc_id", "text")]
    at = 0
    while at < table.num_rows:
        size, end = 0, at
        lens = pc.binary_length(cols[3].slice(at, 2048)).to_pylist()
        while end - at < len(lens) and (end == at or size + lens[end - at] <= _CHUNK):
            size += lens[end - at]
            end += 1
        part = [c.slice(at, end - at).to_pylist() for c in cols]
        yield part[0][0], part[1], part[2], part[3]
        at = end


def _least(n, percent: int):
    """The smallest overlap with any set that reaches ``percent``."""
    return -(-percent * n // 100)


def _first_prefixes(shards: int, words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, _, texts in _texts(batch):
                toks, owner = [], []
                for row, s in zip(rows, shingle_sets(texts, words), strict=True):
                    n = len(s)
                    if n:
                        p = n - _least(n, percent) + max(1, n // 10)
                        toks.append(s[:p])
                        owner.append(np.full(len(toks[-1]), row))
                if not toks:
                    continue
                tok, own = mix(np.concatenate(toks) + U(1)), np.concatenate(owner)
                out = []
                for s, (t, r) in by_shard(shard_of(tok, shards), tok, own):
                    edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    out.append((s, block, pack((t & U(0xFFFFFFFF)).astype(np.uint32), r[edge], np.diff(np.concatenate((edge, [len(r)]))).astype(np.uint32))))
                yield packed_batch(out)

    return run


def _shared(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Per block and row: how many of the tokens sent are another row's as well."""
    parts = [(b, *unpack(p)) for b, p in rows]
    tok = np.concatenate([x[1] for x in parts])
    order = np.argsort(tok, kind="stable")
    t = tok[order]
    same = np.zeros(len(t) + 1, dtype=bool)
    same[1:-1] = t[1:] == t[:-1]
    shared = np.zeros(len(t), dtype=bool)
    shared[order] = same[1:] | same[:-1]
    at = 0
    for b, t, row, runs in parts:
        own = np.repeat(np.arange(len(row)), runs)
        n = np.bincount(own, shared[at : at + len(t)], len(row)).astype(np.uint32)
        at += len(t)
        if n.any():
            yield b, pack(row[n > 0], n[n > 0])


def _node(s: np.ndarray) -> int:
    """A name for a set: 63 bits of its hash."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _M).sum(dtype=np.uint64)
        return int(mix(np.array([a * _M + b + U(len(s))], dtype=np.uint64))[0] >> U(1))


STATES = "doc_id long, n long, node long, pick binary"


def _states(words: int, percent: int):
    """Every row with its set's size; rows that may link with the set's name, and the set itself once for each block."""

    def run(left: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        cols, _ = join_packed([p for _, p in answers])
        found: dict[int, int] = {}
        if cols:
            rows, at = np.unique(cols[0], return_inverse=True)
            found = dict(zip(rows.tolist(), np.bincount(at, cols[1]).astype(int).tolist(), strict=True))
        ids, sizes, nodes, picks, seen = [], [], [], [], set()
        for _, rows, docs, texts in _texts(left):
            for row, doc, s in zip(rows, docs, shingle_sets(texts, words), strict=True):
                n = len(s)
                ids.append(doc)
                sizes.append(n)
                # A partner has at least percent of n tokens and asks for a tenth of its own.
                if n and found.get(row, 0) >= max(1, _least(n, percent) // 10):
                    k = _node(s)
                    nodes.append(k)
                    picks.append(None if k in seen else s.tobytes())
                    seen.add(k)
                else:
                    nodes.append(None)
                    picks.append(None)
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(picks, pa.binary())], names=["doc_id", "n", "node", "pick"])

    return run


# ---- among the sets that may link ----------------------------------------------------------------------------------------------


def _send_tokens(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, _, sets in _texts(batch):
                tok = mix(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in sets]) + U(1))
                own = np.repeat(np.array(rows), [len(x) // 8 for x in sets])
                out = []
                for s, (t, r) in by_shard(shard_of(tok, shards), tok, own):
                    edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                    out.append((s, block, pack((t & U(0xFFFFFFFF)).astype(np.uint32), r[edge], np.diff(np.concatenate((edge, [len(r)]))).astype(np.uint32))))
                yield packed_batch(out)

    return run


def _count(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """How many sets hold each token sent, in the order sent."""
    parts = [(b, *unpack(p)) for b, p in rows]
    _, at, n = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True, return_counts=True)
    df, start = n[at].astype(np.uint32), 0
    for b, t, row, runs in parts:
        yield b, pack(df[start : start + len(t)], row, runs)
        start += len(t)


def choose_length(df: np.ndarray, percent: int) -> int:
    """How many shared tokens to ask for, given the frequencies of a set's tokens in order.

    A longer prefix costs the candidates its tokens bring; asking for l of them leaves about one candidate in l to verify.
    """
    n = len(df)
    base = n - _least(n, percent)
    most = max(1, min(_least(n, percent), n - base))
    steps = np.unique(np.minimum(most, np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])))
    cost = np.cumsum(df.astype(np.float64) - 1)[np.minimum(base + steps, n) - 1]
    return int(steps[np.argmin(cost + cost / steps * (n / 8 + 4))])


PREFIXES = "node long, n int, asks int, own int, places binary, tokens binary"


def _prefixes(shards: int, percent: int):
    def run(left: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        parts = [unpack(p) for _, p in answers]  # by shard
        df = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.uint32)
        own = np.concatenate([np.repeat(p[1], p[2]) for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        turn = np.argsort(own, kind="stable")
        df, own = df[turn], own[turn]
        out = []
        for _, rows, nodes, sets in _texts(left):
            for row, node, raw in zip(rows, nodes, sets, strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                a = np.searchsorted(own, row)
                f = np.empty(len(s), dtype=np.int64)
                f[np.argsort(shard_of(mix(s + U(1)), shards), kind="stable")] = df[a : a + len(s)]
                order = np.lexsort((s, f))
                f, t = f[order], s[order]
                asks = choose_length(f, percent)
                p = len(s) - _least(len(s), percent) + asks
                places = np.flatnonzero(f[:p] > 1)
                if len(places):
                    out.append((node, len(s), asks, int((f == 1).sum()), places.astype(np.uint32).tobytes(), t[places].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PREFIXES.split(", ")])

    return run


def _post(shards: int):
    """Prefix tokens to their shards: node, label, size, asked number, own tokens, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.to_pydict()
            tok = [np.frombuffer(x, dtype=np.uint64) for x in d["tokens"]]
            runs = [len(x) for x in tok]
            tok = np.concatenate(tok)
            place = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in d["places"]])
            wide = [np.repeat(np.array(d[c], dtype=np.int64), runs) for c in ("node", "label", "n", "asks", "own")]
            yield packed_batch([(s, 0, pack(*c)) for s, c in by_shard(shard_of(mix(tok + U(1)), shards), tok, *wide, place)])

    return run


def _fits(percent: int, nx, px, ny, py, asks):
    """Whether a token shared at these places can be among the first ``asks`` shared ones of two sets similar enough."""
    need = -(-percent * (nx + ny) // (100 + percent))
    return (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & (px < nx - need + asks) & (py < ny - need + asks)


def _stars(percent: int):
    def run(group: pa.Table) -> pa.Table:
        cols, _ = join_packed(group.column("payload").to_pylist())
        order = np.lexsort((cols[1], cols[5], cols[0]))
        tok, node, _, n, asks, _, place = (c[order] for c in cols)
        place = place.astype(np.int64)
        new = np.concatenate(([True], tok[1:] != tok[:-1]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        ok = (node != node[lead]) & _fits(percent, n, place, n[lead], place[lead], np.minimum(asks, asks[lead]))
        pairs = np.unique(np.stack((node[ok], node[lead[ok]])), axis=1)
        return pa.table([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return run


def _across(percent: int, shards: int, chunk: int = 1 << 18, most_held: int = 1 << 20):
    """Pairs of different labels in the tokens' lists, with how many of this shard's tokens they share, to shards of pairs."""

    def run(group: pa.Table) -> pa.Table:
        cols, _ = join_packed(group.column("payload").to_pylist())
        order = np.argsort(cols[0], kind="stable")
        tok, node, label, n, asks, _, place = (c[order] for c in cols)
        place = place.astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1], [True])))
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if z - a < 2 or (label[a:z] == label[a]).all():
                continue
            step = max(1, chunk // (z - a))
            for i in range(a, z, step):
                j = min(z, i + step)
                x, y = slice(i, j), slice(i, z)
                ok = (label[x][:, None] != label[y][None, :]) & _fits(percent, n[x][:, None], place[x][:, None], n[y][None, :], place[y][None, :], np.minimum(asks[x][:, None], asks[y][None, :]))
                p, q = np.nonzero(ok)
                keep = p < q
                p, q = p[keep] + i, q[keep] + i
                if len(p):
                    held.append((np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), np.minimum(asks[p], asks[q]), np.ones(len(p), dtype=np.int64)))
                    waiting += len(p)
                if waiting > most_held:  # what is held twice is added up, so that no more than the different pairs stay
                    held = [_summed(held)]
                    waiting = min(len(held[0][0]), most_held // 2)
        if not held:
            return pa.Table.from_batches([packed_batch([])])
        pairs = _summed(held)
        del held
        to = shard_of(mix(pairs[0].astype(np.uint64) * _M + pairs[1].astype(np.uint64)), shards)
        out = pa.Table.from_batches([packed_batch([(s, 0, pack(*c)) for s, c in by_shard(to, *pairs)])])
        del pairs
        release()
        return out

    return run


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (a, b, asked) of all parts and the sums of their counts."""
    a, b, asks, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((asks, b, a))
    a, b, asks, count = a[order], b[order], asks[order], count[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (asks[1:] != asks[:-1]))))
    return a[new], b[new], asks[new], np.add.reduceat(count, new)


def _enough(group: pa.Table) -> pa.Table:
    parts = [unpack(p) for p in group.column("payload").to_pylist()]
    a, b, asks, count = _summed(parts)
    keep = count >= asks
    return pa.table([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):  # whole sets, a few at a time
                d = batch.slice(at, 256).to_pydict()
                for x, y in zip(d["x"], d["y"], strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b", "p", "q"]).filter(pa.array(keep, pa.bool_()))
        release()

    return run


NODE = "struct<id:long,node:long>"


def _named(id_: str, node: str) -> Column:
    """A set as a node: ordered by its smallest doc_id (null last), told apart by its name."""
    return F.struct(F.coalesce(F.col(id_), F.lit(_LAST)).alias("id"), F.col(node).alias("node"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names that are similar enough, as nodes: their smallest doc_ids come along, so that no later join by
    component is needed."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("pick").alias("x"), F.col("first_id").alias("p")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("pick").alias("y"), F.col("first_id").alias("q")), "b")
    found = two.select("a", "b", "p", "q", "x", "y").mapInArrow(_verify(percent), "a long, b long, p long, q long")
    return found.select(_named("p", "a").alias("a"), _named("q", "b").alias("b"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    with Blocks(docs) as blocks:
        told = blocks.answer(blocks.emit(_first_prefixes(blocks.shards, words, percent)), _shared)
        # A block without any answer still needs its rows' sizes: co-grouping keeps it.
        states = settle(blocks.with_answers(told, _states(words, percent), STATES))
    live = states.where("node is not null")
    sets = settle(live.groupBy("node").agg(F.first("pick", ignorenulls=True).alias("pick"), F.min("doc_id").alias("first_id")))
    # Never more than the documents: their number of shards will do.
    with Blocks(sets.select(F.col("node").alias("doc_id"), F.col("pick").alias("text")), shards=blocks.shards) as inner:
        shards = inner.shards
        prefixes = settle(inner.with_answers(inner.answer(inner.emit(_send_tokens(shards)), _count), _prefixes(shards, percent), PREFIXES))
    stars = prefixes.withColumn("label", F.col("node")).mapInArrow(_post(shards), PACKED).groupBy("shard").applyInArrow(_stars(percent), "a long, b long").distinct()
    links = settle(_links(stars, sets, percent))
    label = components(links)
    root = label.select(F.col("node.node").alias("node"), F.col("root.node").alias("label"))
    labelled = prefixes.join(root, "node", "left").withColumn("label", F.coalesce("label", "node"))
    across = labelled.mapInArrow(_post(shards), PACKED).groupBy("shard").applyInArrow(_across(percent, shards), PACKED).groupBy("shard").applyInArrow(_enough, "a long, b long")
    more = settle(_links(across, sets, percent))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    first = label.select(F.col("node.node").alias("node"), F.nullif(F.col("root.id"), F.lit(_LAST)).alias("component_id"))
    named = sets.select("node", "first_id").join(first.withColumn("linked", F.lit(True)), "node", "left")
    by_node = named.select("node", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    # Many rows can share a set. Names and ids of the sets go to all executors up to 1,000,000 of them, 16 MB.
    by_node = F.broadcast(by_node) if sets.count() <= MOST_BROADCAST else by_node
    rows = live.join(by_node, "node", "left").unionByName(states.where("node is null").withColumn("component_id", F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are similar to one of smaller id, directly or through others."""
    gone = settle(similar_groups(docs, words, percent).where("component_id < doc_id").select("doc_id").distinct())
    # The ids go to all executors only up to a number: 1,000,000 of them are 8 MB.
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "doc_id", "left_anti")


def oracle(words: int, percent: int) -> str:
    """The same by definition, for small data: shingles as texts, all pairs that share one, and what can be reached by links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= {words} THEN '' ELSE len(w) || ':' END || array_to_string(w[i + 1 : i + {words}], ' ') AS g FROM w, range(0, greatest(1, len(w) - {words - 1})) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.d WHERE reach.r < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(r) AS c FROM reach GROUP BY 1) m ON m.d = w.doc_id"""
