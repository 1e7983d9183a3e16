"""Removing repeated passages by longest-previous-factor arrays (operator 10).

A byte goes if it is covered by a string of ``least`` bytes that also starts earlier: in a document of smaller id, or earlier in
the same one. Rows that repeat an id, and rows without one (they come last), follow each other in the order of the table.

Two equal strings of ``least`` bytes choose the same anchor inside them: the position of the smallest hash among their grams. So it
is enough to compare the surroundings of equal anchors:

1. Every block sends its anchors with a hash of their whole surroundings (all strings that could choose them) and their place.
   A shard answers which surroundings are the first of their kind everywhere. The others are repeated as a whole, and a group of
   any number of copies has one first surrounding per anchor. Surroundings count as equal by hashes (64 bits of their bytes, 32 of
   the anchor); these copies never reach a suffix array.
2. Where an anchor has several different surroundings, the first of each kind is sent as text. A shard lays these texts out by
   place, builds their suffix array and the longest-previous-factor array (from the previous and next smaller positions in suffix
   order), and answers which starts have an earlier match of at least ``least`` bytes.
3. An anchor with more than ``at_once`` kinds of surroundings (the edge of a passage that many documents share) is no single task's
   work. A block settles its own kinds of it first, by the same arrays, so that a string it holds many times is asked once; what is
   left is dealt over several shards by the first and last bytes of each string, equal strings together, and goes through the same
   arrays there, place by place.

The spans come back to the blocks, where the texts are. Strings are judged on the input. Null and empty texts have no bytes; an empty
table gives an empty result; texts of any length are gone through in stretches that overlap by what a string needs; further columns
of any name are kept by without_repeats() and not read otherwise. Shards and blocks are bounded by the input's partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Blocks, by_shard, join_packed, pack, packed_batch, shard_of, unpack
from .common import _BYTE, U, _powers, mix, settle

LEAST = 100
GRAM = 40
PIECE = 1_900_000
LAST = (1 << 63) - 1


# ---- arrays over one string ---------------------------------------------------------------------------------------------------


def ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(n, class of the n bytes from each position) for doubling n up to exactly ``length``; classes are in byte order.

    Beyond the end stands a value below all bytes. ``text`` holds small integers.
    """
    n = len(text)
    _, at = np.unique(text, return_inverse=True)
    rank = at.astype(np.int64) + 1
    out, done = [(1, rank)], 1
    while done < length:
        step = min(done, length - done)
        other = np.zeros(n, dtype=np.int64)
        other[: max(0, n - step)] = rank[step:]
        _, at = np.unique(rank * (n + 2) + other, return_inverse=True)
        rank = at.astype(np.int64) + 1
        done += step
        out.append((done, rank))
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of the whole text."""
    return np.argsort(ranks(text, max(1, len(text)))[-1][1], kind="stable") if len(text) else np.zeros(0, dtype=np.int64)


def smaller(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest place before and after it that holds a smaller position, or -1."""

    def nearest(a: np.ndarray) -> np.ndarray:
        near = np.arange(-1, len(a) - 1)
        live = np.flatnonzero((near >= 0) & (a[near] > a))
        while len(live):  # jump along the links of what is already known to be larger
            near[live] = near[near[live]]
            live = live[(near[live] >= 0) & (a[near[live]] > a[live])]
        return near

    after = nearest(order[::-1])[::-1]
    return nearest(order), np.where(after >= 0, len(order) - 1 - after, -1)


def previous_factor(text: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the longest factor from each position that also starts earlier."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    levels = ranks(text, most)
    order = np.argsort(levels[-1][1], kind="stable")  # equal factors of ``most`` bytes by position

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to ``most``; -1 in b: none."""
        got = np.zeros(len(a), dtype=np.int64)
        ok = b >= 0
        sizes = [s for s, _ in levels]
        full = levels[-1][1]
        same = ok & (full[a] == full[np.maximum(b, 0)]) & (np.maximum(a, b) + most <= n)
        steps = [(s, r) for s, r in levels if s & (s - 1) == 0]
        for s, r in reversed(steps):
            i, j = a + got, b + got
            fit = ok & (i + s <= n) & (j + s <= n) & (got + s <= most)
            fit[fit] = r[i[fit]] == r[j[fit]]
            got[fit] += s
        # A length is at most 2 * largest step - 1 this way; full factors are known from the last level.
        got[same] = most
        return got if sizes else got

    return _longest(order, common)


def _longest(order: np.ndarray, common) -> np.ndarray:
    """For each position, the longer of its common prefixes with the nearest smaller positions before and after it in suffix order."""
    out = np.zeros(len(order), dtype=np.int64)
    for near in smaller(order):
        other = np.where(near >= 0, order[np.maximum(near, 0)], -1)
        out[order] = np.maximum(out[order], common(order, other))
    return out


# ---- anchors -------------------------------------------------------------------------------------------------------------------


def _gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, by joining hashes of halves."""
    level, size = _BYTE[buf], 1
    out, have, power = None, 0, 0xD1342543DE82EF95
    while True:
        factor = U(power)
        if k & size:
            if out is None:
                out = level[: len(buf)].copy()
            else:
                n = len(level) - have
                out = out[:n] * factor + level[have : have + n]
            have += size
        if size * 2 > k:
            break
        n = len(level) - size
        level = level[:n] * factor + level[size:]
        power = power * power % (1 << 64)
        size *= 2
    return mix(out[: len(buf) - k + 1])


def _slide(a: np.ndarray, w: int, pick) -> np.ndarray:
    """The pick (minimum or maximum) of each w neighbours."""
    size = 1
    while size * 2 <= w:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def anchors(buf: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text of at least ``least`` bytes.

    A gram is an anchor if it has the smallest hash in some string of ``least`` bytes; all equal smallest ones are.
    """
    h = _gram_hashes(buf, gram)
    w = least - gram + 1
    low = _slide(h, w, np.minimum)
    pad = np.zeros(w - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), w, np.maximum) == h)
    return at, h[at]


def _surroundings(buf: np.ndarray, at: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of all bytes of the strings that could choose each anchor."""
    lo, hi = np.maximum(at - (least - gram), 0), np.minimum(at + least, len(buf))
    power = _powers(len(buf) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[buf] * power[0][: len(buf)])))
    h = (sums[hi] - sums[lo]) * power[1][lo]
    # What lies before and after the anchor is part of the identity.
    return lo, hi, mix(h + mix(((at - lo).astype(np.uint64) << U(32)) + (hi - lo).astype(np.uint64)))


def _texts(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, bytes]]:
    """block, row, doc_id, bytes of each row."""
    cols = [table.column(table.schema.get_field_index(c)) for c in ("block", "row", "doc_id", "text")]
    for at in range(0, table.num_rows, 256):
        for b, r, d, t in zip(*(c.slice(at, 256).to_pylist() for c in cols), strict=True):
            yield b, r, LAST if d is None else d, np.frombuffer(t, dtype=np.uint8), t


def _pieces(buf: np.ndarray, least: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a text, a bounded stretch at a time: position, hash, start and end of surroundings, their hash."""
    margin = 2 * least
    for at in range(0, len(buf), PIECE):
        lo, hi = max(0, at - margin), min(len(buf), at + PIECE + margin)
        part = buf[lo:hi]
        if len(part) < least:
            continue
        pos, h = anchors(part, least, gram)
        own = (pos + lo >= at) & (pos + lo < at + PIECE)
        pos, h = pos[own], h[own]
        if not len(pos):
            continue
        a, b, c = _surroundings(part, pos, least, gram)
        yield pos + lo, h, a + lo, b + lo, c


class Gathered:
    """Anchors of a stretch of texts, deduplicated and sent out when there are enough."""

    def __init__(self) -> None:
        self.cols: list[list[np.ndarray]] = [[], [], [], [], []]
        self.n = 0

    def add(self, h: np.ndarray, c: np.ndarray, doc: int, row: int, pos: np.ndarray) -> None:
        k = len(h)
        for col, x in zip(self.cols, (h, c, np.full(k, doc), np.full(k, row), pos.astype(np.int64)), strict=True):
            col.append(x)
        self.n += k

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(c) for c in self.cols]


def _first_of_kind(h: np.ndarray, c: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (h, c, place), and whether each of that order is the first of its (h, c)."""
    order = np.lexsort((*place[::-1], c, h))
    hs, cs = h[order], c[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    return order, new


def _send_anchors(shards: int, least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = Gathered(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held.n:
                return
            h, c, doc, row, pos = held.columns()
            held = Gathered()
            order, new = _first_of_kind(h, c, doc, row, pos)
            keep = np.sort(order[new])
            h, c, doc, row, pos = (x[keep] for x in (h, c, doc, row, pos))
            rows = []
            # Anchors are the smallest hashes around, so their own upper bits would all meet in the first shards.
            for s, (hh, cc, dd, rr, pp) in by_shard(shard_of(mix(h + U(1)), shards), h, c, doc, row, pos):
                edge = np.flatnonzero(np.concatenate(([True], (rr[1:] != rr[:-1]))))
                runs = np.diff(np.concatenate((edge, [len(rr)])))
                rows.append((s, block, pack((hh & U(0xFFFFFFFF)).astype(np.uint32), cc, pp.astype(np.uint32), dd[edge], rr[edge], runs.astype(np.uint32))))
            yield packed_batch(rows)

        for batch in batches:
            for b, row, doc, buf, _ in _texts(batch):
                if b != block:
                    yield from flush()
                    block = b
                for pos, h, _, _, c in _pieces(buf, least, gram):
                    held.add(h, c, doc, row, pos)
                if held.n > 400_000:
                    yield from flush()
        yield from flush()

    return run


def _judge(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Per block: anchors that are no first of their kind (1), and firsts of a kind where there are other kinds (2) and how many."""
    parts = []
    for b, p in rows:
        h, c, pos, dd, rr, runs = unpack(p)
        parts.append((h, c, pos, np.repeat(dd, runs), np.repeat(rr, runs), np.full(len(h), b, dtype=np.int32)))
    h, c, pos, doc, row, block = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order, new = _first_of_kind(h, c, doc, row, pos)
    hs = h[order]
    group = np.cumsum(np.concatenate(([True], hs[1:] != hs[:-1]))) - 1
    kinds = np.bincount(group, new)
    state = np.where(~new, 1, np.where(kinds[group] > 1, 2, 0))
    told = np.flatnonzero(state)
    at = order[told]
    state, kinds = state[told].astype(np.uint8), kinds[group[told]].astype(np.uint32)
    turn = np.argsort(block[at], kind="stable")
    at, state, kinds = at[turn], state[turn], kinds[turn]
    edges = np.flatnonzero(np.diff(block[at])) + 1
    for idx, st, many in zip(np.split(at, edges), np.split(state, edges), np.split(kinds, edges), strict=True):
        if len(idx):
            yield int(block[idx[0]]), pack(row[idx], pos[idx], st, h[idx], many)


def _by_row(answers: list[bytes]) -> tuple[list[np.ndarray], dict[int, tuple[int, int]]]:
    """The joined columns of answers, sorted by row and position, and each row's range."""
    cols, _ = join_packed(answers)
    if not cols:
        return [], {}
    order = np.lexsort((cols[1], cols[0]))
    cols = [c[order] for c in cols]
    rows, first = np.unique(cols[0], return_index=True)
    return cols, {int(r): (int(a), int(b)) for r, a, b in zip(rows, first, [*first[1:], len(order)], strict=True)}


AT_ONCE = 2048


def _send_texts(shards: int, least: int, gram: int, at_once: int = AT_ONCE):
    """Surroundings to shards; of anchors with many kinds, what the block can't settle by itself to further shards."""
    width, before = 2 * least - gram, least - gram

    def run(left: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        cols, ranges = _by_row([p for _, p in answers])
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        block = None
        for b, row, doc, buf, _ in _texts(left):
            block = b
            if row not in ranges:
                continue
            a, z = ranges[row]
            ask = cols[2][a:z] == 2
            pos, h, kinds = cols[1][a:z][ask].astype(np.int64), cols[3][a:z][ask], cols[4][a:z][ask]
            if not len(pos):
                continue
            # The surroundings, laid out with the anchor at the same place; what the text doesn't have is no byte.
            take = pos[:, None] - before + np.arange(width)[None, :]
            inside = (take >= 0) & (take < len(buf))
            chars = np.where(inside, buf[np.clip(take, 0, len(buf) - 1)].astype(np.uint16) + np.uint16(1), np.uint16(0))
            for col, x in zip(out, (h, np.full(len(pos), doc), np.full(len(pos), row), pos.astype(np.uint32), chars, kinds), strict=True):
                col.append(x)
        if not out[0]:
            return pa.Table.from_batches([packed_batch([])])
        h, doc, row, pos, chars, kinds = (np.concatenate(x) for x in out)
        cold = kinds <= at_once
        rows = [
            (s, block, pack(hh, dd, rr, pp, *_packed_chars(cc)))
            for s, (hh, dd, rr, pp, cc) in by_shard(shard_of(mix(h[cold].astype(np.uint64) + U(1)), shards), h[cold], doc[cold], row[cold], pos[cold], chars[cold])
        ]
        if not cold.all():
            hot = np.flatnonzero(~cold)
            hot = hot[np.lexsort((pos[hot], row[hot], doc[hot], h[hot]))]
            rows.extend((s, block, p) for s, p in _send_hot(shards, before, least, at_once, h[hot], doc[hot], row[hot], pos[hot], chars[hot], kinds[hot], block))
        return pa.Table.from_batches([packed_batch(rows)])

    return run


def _packed_chars(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and beside them a bit for each that the text doesn't have."""
    absent = chars == 0
    return (np.where(absent, 1, chars) - 1).astype(np.uint8).ravel(), np.packbits(absent, axis=1).ravel()


def _unpacked_chars(chars: np.ndarray, absent: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return chars.reshape(n, width), np.unpackbits(absent.reshape(n, -1), axis=1, count=width).astype(bool)


def _send_hot(shards: int, before: int, least: int, at_once: int, h: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, chars: np.ndarray, kinds: np.ndarray, block: int) -> Iterator[tuple[int, bytes]]:
    """Texts come by anchor and place. Starts settled in the block go back to it, the others are asked by the string's own bytes."""
    starts = before + 1
    bare, absent = (np.where(chars == 0, 1, chars) - 1).astype(np.uint8), chars == 0
    told = np.zeros((len(h), starts), dtype=bool)
    for idx in _anchor_groups(h, at_once):
        for i, x in _earlier(h[idx], bare[idx], absent[idx], before, least, at_once):
            told[idx[i], x] = True
    i, x = np.nonzero(told)
    if len(i):
        yield 2 * shards + block % shards, pack(row[i], pos[i].astype(np.int64) - before + x)
    gaps = np.cumsum(np.pad(absent, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
    ask = ~told & (gaps[:, least : least + starts] == gaps[:, :starts])
    # Eight bytes from each place, as one number.
    eight = np.zeros((len(h), bare.shape[1] - 7), dtype=np.uint64)
    for k in range(8):
        eight = (eight << U(8)) | bare[:, k : k + eight.shape[1]]
    i, x = np.nonzero(ask)
    name = mix(eight[i, x] * U(0xD1342543DE82EF95) + mix(eight[i, x + least - 8] + x.astype(np.uint64)))
    parts = -(-kinds[i].astype(np.int64) // at_once)
    part = name % parts.astype(np.uint64)
    shard = shards + shard_of(mix((h[i].astype(np.uint64) << U(32)) + part + U(1)), shards).astype(np.int64)
    for s, (who, at) in by_shard(shard, i, x):
        texts, mine = np.unique(who, return_inverse=True)
        mask = np.zeros((len(texts), starts), dtype=bool)
        mask[mine, at] = True
        yield s, pack(h[texts], doc[texts], row[texts], pos[texts], *_packed_chars(chars[texts]), np.packbits(mask, axis=1).ravel())


def _anchor_groups(h: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """Ranges of texts in order of their anchors: whole anchors, as many as fit; a larger one alone."""
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, dtype=np.int64)
    start = 0
    while start < len(edge) - 1:
        stop = start + 1
        while stop < len(edge) - 1 and edge[stop + 1] - edge[start] <= at_once:
            stop += 1
        yield np.arange(edge[start], edge[stop])
        start = stop


def _factors(least: int, gram: int, at_once: int = AT_ONCE):
    """In a shard: texts of equal anchors by place, their suffix order, and the starts whose previous factor is long enough."""
    width, left = 2 * least - gram, least - gram

    def run(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        cols, sizes = join_packed([p for _, p in rows])
        if len(cols) == 2:  # settled where they come from
            yield from rows
            return
        h, doc, row, pos, chars, absent = cols[:6]
        block = np.repeat(np.array([b for b, _ in rows]), sizes)
        chars, absent = _unpacked_chars(chars, absent, len(h), width)
        order = np.lexsort((pos, row, doc, h))
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def note(k: np.ndarray, x: np.ndarray) -> None:
            for b in np.unique(block[k]):
                m = block[k] == b
                found.setdefault(int(b), []).append((row[k][m], pos[k][m].astype(np.int64) - left + x[m]))

        if len(cols) == 6:
            for idx in _anchor_groups(h[order], at_once):
                idx = order[idx]
                for i, x in _earlier(h[idx], chars[idx], absent[idx], left, least, at_once):
                    note(idx[i], x)
        else:
            ask = np.unpackbits(cols[6].reshape(len(h), -1), axis=1, count=left + 1).astype(bool)
            for x in range(left + 1):
                some = order[ask[order, x]]
                for idx in _anchor_groups(h[some], 16 * at_once):
                    idx = some[idx]
                    i = np.flatnonzero(_factors_of_strings(h[idx], chars[idx, x : x + least]) >= least)
                    if len(i):
                        note(idx[i], np.full(len(i), x))
        for b, hits in found.items():
            yield b, pack(np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits]))

    return run


def _earlier(h: np.ndarray, chars: np.ndarray, absent: np.ndarray, left: int, least: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a text, start in it) of the strings that a text before it has at the same place. Texts come by anchor and place.

    A group of more than ``at_once`` texts goes part by part; a text all of whose strings were there before is not compared again.
    """
    known = np.zeros(0, dtype=np.int64)
    for at in range(0, len(h), at_once):
        part = np.arange(at, min(len(h), at + at_once))
        idx = np.concatenate((known, part))
        i, x = _factor_hits(h[idx], chars[idx], absent[idx], left, least)
        new = i >= len(known)
        i, x = i[new], x[new]
        yield idx[i], x
        if at + at_once < len(h):
            hits = np.bincount(i - len(known), minlength=len(part))
            known = np.concatenate((known, part[hits <= left]))


def _factor_hits(h: np.ndarray, chars: np.ndarray, absent: np.ndarray, left: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts with an earlier match of ``least`` bytes."""
    return np.nonzero(_previous_factors(h, chars, absent, left, least) >= least)


def _previous_factors(h: np.ndarray, chars: np.ndarray, absent: np.ndarray, left: int, least: int) -> np.ndarray:
    """Longest previous factors, up to ``least``, of the places 0 to ``left`` of each text: as previous_factor() gives for all of them.

    A symbol is a byte with its anchor and its place beside the anchor, so that the longest previous factor can only come from the
    same string of the same anchor, never from the same bytes seen from another one. The suffix order of such texts falls apart by
    place: it is built place by place, each a sort of as many entries as there are texts, doubling the length known and keeping at
    each step only the places that still matter. The orders of all places, one after the other, are the suffix order of the whole;
    the previous and next smaller positions are sought in it, and the classes of each step give the common prefixes with them.
    """
    n, width = chars.shape
    _, group = np.unique(h, return_inverse=True)
    group = group.astype(np.int64)
    byte = np.where(absent, 0, chars.astype(np.int64) + 1).T.copy()  # by place; what the text doesn't have is no byte, not a zero
    pair = (byte[:-1] << 9) | byte[1:]
    rank, step = _classes((group << 36) | (pair[:-2] << 18) | pair[2:]), 4
    flat = [(1, ((group << 9) | byte).ravel()), (2, ((group << 18) | pair).ravel()), (4, rank.ravel())]  # position: place * n + text
    kind = np.int32 if (n + 1) ** 2 < 1 << 31 else np.int64
    while step < least:
        add = min(step, least - step)
        rank = _classes(rank[: len(rank) - add].astype(kind) * kind(n + 1) + rank[add:])
        step += add
        flat.append((step, rank.ravel()))
    order = np.argsort(rank[: left + 1], axis=1, kind="stable")

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero((b >= 0) & (a // n == b // n))
        i, j = a[live], b[live]
        same = flat[-1][1][i] == flat[-1][1][j]
        got[live[same]] = least
        live, i, j = live[~same], i[~same], j[~same]
        known = np.zeros(len(live), dtype=np.int64)
        for s, r in reversed(flat[:-1]):
            fit = known + s <= least
            fit[fit] = r[i[fit] + known[fit] * n] == r[j[fit] + known[fit] * n]
            known[fit] += s
        got[live] = known
        return got

    factor = _longest((order + np.arange(left + 1)[:, None] * n).ravel(), common).reshape(left + 1, n).T
    room = np.zeros((n, width + 1), dtype=np.int64)  # bytes from each place to the text's end
    for x in range(width - 1, -1, -1):
        room[:, x] = np.where(absent[:, x], 0, room[:, x + 1] + 1)
    return np.minimum(factor, room[:, : left + 1])


def _factors_of_strings(h: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """The same for one place: longest previous factors of the first place of strings of equal size, all of them bytes.

    Strings come by anchor and place. With one place there is nothing to share between orders: the strings are sorted as they are.
    """
    n, size = strings.shape
    rows = np.empty((n, 4 + size), dtype=np.uint8)
    rows[:, :4] = np.unique(h, return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(n, 4)
    rows[:, 4:] = strings
    order = np.argsort(rows.view(f"V{4 + size}").ravel(), kind="stable")

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero((b >= 0) & (h[a] == h[b]))
        differ = rows[a[live], 4:] != rows[b[live], 4:]
        got[live] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        return got

    return _longest(order, common)


def _classes(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of each row's keys."""
    out = np.empty(keys.shape, dtype=np.int32)
    order = np.argsort(keys, axis=1)
    ranked = np.take_along_axis(keys, order, axis=1)
    new = np.zeros(keys.shape, dtype=np.int32)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    np.put_along_axis(out, order, np.cumsum(new, axis=1, dtype=np.int32), axis=1)
    return out


def _runs(left: pa.Table, answers: list[tuple[int, bytes]], shards: int, least: int, gram: int) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """Number, bytes and removed runs of each row of a block, from both kinds of answers (the later kind has high shard numbers)."""
    cols, ranges = _by_row([p for s, p in answers if s < shards])
    hits, at_row = _by_row([p for s, p in answers if s >= shards])
    # Surroundings that this block holds more than once were sent once; the later ones are repeated as well.
    marks: dict[int, np.ndarray] = {}
    keys, places, numbers = [], [], []
    ids = left.column("doc_id").fill_null(LAST).to_numpy()
    turn = np.lexsort((left.column("row").to_numpy(), ids)).astype(np.int32)  # texts in their order
    rank = np.empty(len(turn), dtype=np.int32)
    rank[turn] = np.arange(len(turn), dtype=np.int32)
    for n, (_, _, _, buf, _) in enumerate(_texts(left)):
        for pos, h, _, _, c in _pieces(buf, least, gram):
            keys.append(mix(h) ^ c)
            places.append(pos.astype(np.uint32))
            numbers.append(np.full(len(pos), rank[n]))
    if keys:
        key, pos, num = np.concatenate(keys), np.concatenate(places), np.concatenate(numbers)
        del keys, places, numbers
        order = np.lexsort((pos, num, key))
        again = order[1:][key[order[1:]] == key[order[:-1]]]
        again.sort()
        edges = np.flatnonzero(np.diff(num[again])) + 1
        marks = {int(turn[num[i[0]]]): pos[i].astype(np.int64) for i in np.split(again, edges) if len(i)}
        del key, pos, num, order
    none = np.zeros(0, dtype=np.int64)
    for n, (_, row, _, buf, raw) in enumerate(_texts(left)):
        a, z = ranges.get(row, (0, 0))
        whole = np.concatenate((marks.get(n, none), cols[1][a:z][cols[2][a:z] == 1].astype(np.int64) if z else none))
        b, y = at_row.get(row, (0, 0))
        starts = hits[1][b:y] if y else none
        if not len(whole) and not len(starts):
            yield n, raw, []
            continue
        cover = np.zeros(len(buf) + 1, dtype=np.int32)
        np.add.at(cover, np.concatenate((np.maximum(whole - (least - gram), 0), starts)), 1)
        np.add.at(cover, np.concatenate((np.minimum(whole + least, len(buf)), starts + least)), -1)
        on = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        yield n, raw, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _answers(blocks: Blocks, least: int, gram: int, at_once: int) -> DataFrame:
    shards = blocks.shards
    first = blocks.answer(blocks.emit(_send_anchors(shards, least, gram)), _judge)
    first = settle(first)
    texts = blocks.with_answers(first, _send_texts(shards, least, gram, at_once), "shard int, block int, payload binary")
    later = blocks.answer(texts, _factors(least, gram, at_once)).selectExpr(f"shard + {shards} as shard", "block", "payload")
    return first.unionByName(later)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, at_once: int = AT_ONCE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): bytes, removed bytes and runs, and the digest of what is kept."""
    blocks = Blocks(docs)
    shards = blocks.shards

    def run(left: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        size, gone, spans, digest = [], [], [], []
        for _, raw, runs in _runs(left, answers, shards, least, gram):
            size.append(len(raw))
            gone.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            digest.append(hashlib.sha256(_kept(raw, runs)).hexdigest())
        kind = pa.int64()
        return pa.table([left.column("doc_id"), pa.array(size, kind), pa.array(gone, kind), pa.array(spans, kind), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    with blocks:
        return settle(blocks.with_answers(_answers(blocks, least, gram, at_once), run, DIGEST))


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, at_once: int = AT_ONCE) -> DataFrame:
    """``docs`` with repeated passages cut out; a document that is nothing but repeats goes.

    All columns stay; ``n_chars``, where there is one, is the length of the new text. Bytes of a character cut in two go as well.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    names, schema = docs.columns, docs.schema
    # One more column tells null texts, which stay null, from empty ones.
    blocks = Blocks(docs.select("*", docs["text"].isNull().alias(_fresh("is_null", names))), *more, _fresh("is_null", names))
    shards = blocks.shards
    *stored, no_text = blocks.more

    def run(left: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        texts, new, keep = left.column("text").to_pylist(), {}, []
        for n, raw, runs in _runs(left, answers, shards, least, gram):
            if runs:
                new[n] = _kept(raw, runs).decode(errors="ignore")
            keep.append(not runs or bool(new[n].strip()))
        cols = {"doc_id": left.column("doc_id"), **{c: left.column(k) for c, k in zip(more, stored, strict=True)}}
        null = left.column(no_text).to_pylist()
        cols["text"] = pa.array([None if null[n] else new[n] if n in new else t.decode(errors="replace") for n, t in enumerate(texts)], pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(new[n]) if n in new else x for n, x in enumerate(cols["n_chars"].to_pylist())], cols["n_chars"].type)
        return pa.table([cols[c] for c in names], names=names).filter(pa.array(keep, pa.bool_()))

    with blocks:
        return settle(blocks.with_answers(_answers(blocks, least, gram, at_once), run, schema))


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def oracle(least: int) -> str:
    """The same by definition, for small data: every string of ``least`` bytes by its md5, and whether it is the first."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, {1000 + 2 * least}) AS part FROM d, range(0, length(h) // 1000 + 1) r(k)),
s AS (SELECT doc_id, base + i AS i, md5_number(substr(part, 2 * i + 1, {2 * least})) AS g FROM c, range(0, least(500::BIGINT, length(part) // 2 - {least - 1})) r(i)),
o AS (SELECT g, min(doc_id::HUGEINT * 4294967296 + i) AS first FROM s GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN o USING (g) WHERE doc_id::HUGEINT * 4294967296 + i > first),
k AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {least} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {least} AS z FROM k GROUP BY 1, 2),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM r),
t AS (SELECT doc_id, count(*) AS spans, sum(z - a)::BIGINT AS gone, max(z) AS tail, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE coalesce(kept, '') || substr(h, 2 * tail + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
