"""Language-model scoring with an Elias-Fano n-gram trie (operator 8).

Tokens are the lower-cased words of a text and one end. The model has absolute discounting, interpolated down to the add-one
unigram: P(w | h) = max(c(h, w) - D, 0) / c(h) + D * T(h) / c(h) * P(w | h'), where T(h) counts the different words after h and h'
is h without its first word; after a context never met it is P(w | h'). ``order`` 3 has contexts of one and two words, 2 only of
one: after the first word of a text, the context is only that of the start.

1. Blocks of texts tell word shards their distinct words; the answer is each word's training count and number. Numbers are by the
   whole 64-bit hash, so that from here on words are equal if those hashes are, whatever the shard.
2. Blocks ask context shards about their distinct triples (word before the last, last word, word). They are dealt by the last word
   of the context, so that both context lengths meet in one shard and one exchange serves both. A last word with more than ``hot``
   training tokens is dealt over several shards by the word before it; its own successors, which then lie in several shards, are
   dealt by the successor in an exchange of their own, and blocks add up T over the parts.
3. A shard builds its part of the trie from what is taught and looks the questions up in it: the last words of contexts are a level,
   below each the words before them, below those the successors of two words, and beside them the successors of the last word alone.
   Pointers are monotone, and a range's values are made monotone by adding the last value of the range before; both are Elias-Fano
   coded in one anonymous memory mapping, beside them a byte for each quantised smoothed probability. Codes are as fine as 32 to a
   power of ten, or coarser in a shard whose smallest probability needs it. Questions go through in order: a search finds the window
   of a level by select samples and decodes no more than that window.
4. Sums are made where the texts are.

Null and empty texts are one end. Held-out rows (and rows without an id) teach nothing; with no training tokens at all, p is 1 for
the only class there is. Rows that repeat each count and are scored each. An empty table gives an empty result. Texts of any length
are cut into stretches of tokens, but never between a text's words. Only doc_id and text are read, so further columns can't clash.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, by_shard, pack, packed_batch, shard_of, unpack
from .common import LOWER, U, fold, mix, settle, word_hashes

END, START = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
DISCOUNT = 0.75
HOT = 1 << 20
LOW32 = U(0xFFFFFFFF)
STRETCH = 1_500_000
_PIECE = 1_900_000
GROUP = 1 << 19
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Numbers of words begin at 1. NONE: no word before, or one that training never met.
_START_NUMBER, NONE = 0, (1 << 63) - 1


# ---- Elias-Fano ------------------------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, and the place of every WINDOW-th one bit.

    Arrays may be memory-mapped. Reading decodes one window at a time; nothing but the samples is kept decoded.
    """

    WINDOW = 1 << 14

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, select: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.select = n, low_bits, low, high, select
        self._at, self._held = -1, np.zeros(0, dtype=np.int64)
        self.first = np.array([self._window(k)[0] for k in range(len(select))], dtype=np.int64)

    @classmethod
    def code(cls, values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = []
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            for a in range(0, n, cls.WINDOW):
                part = values[a : a + cls.WINDOW].astype(np.uint64)
                low.append(np.packbits(((part[:, None] >> shifts) & U(1)).astype(np.uint8).ravel(), bitorder="little"))
        at = (values >> bits) + np.arange(n)
        upper = np.zeros((int(at[-1]) if n else 0) + 2, dtype=np.uint8)
        upper[at] = 1
        return n, bits, np.concatenate(low) if low else np.zeros(0, dtype=np.uint8), np.packbits(upper, bitorder="little"), at[:: cls.WINDOW].astype(np.int64)

    def _window(self, k: int) -> np.ndarray:
        if self._at != k:
            a, z = k * self.WINDOW, min(self.n, (k + 1) * self.WINDOW)
            begin = int(self.select[k])
            end = int(self.select[k + 1]) if k + 1 < len(self.select) else 8 * len(self.high)
            bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")
            ones = np.flatnonzero(bits[begin % 8 :])[: z - a] + begin
            values = (ones - np.arange(a, z)) << self.low_bits
            if self.low_bits:
                low = np.unpackbits(self.low[a * self.low_bits // 8 : -(-z * self.low_bits // 8)], bitorder="little")[: (z - a) * self.low_bits].reshape(z - a, self.low_bits)
                for b in range(self.low_bits):
                    values |= low[:, b].astype(np.int64) << b
            self._at, self._held = k, values
        return self._held

    def _by_window(self, k: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(k, kind="stable")
        told = k[order]
        edges = np.flatnonzero(np.concatenate(([True], told[1:] != told[:-1], [True]))) if len(k) else np.zeros(1, dtype=np.int64)
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(told[a]), order[a:z]

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), dtype=np.int64)
        for k, at in self._by_window(i // self.WINDOW):
            out[at] = self._window(k)[i[at] - k * self.WINDOW]
        return out

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least x, else hi: the whole sequence is monotone, and so is any part."""
        out = np.zeros(len(x), dtype=np.int64)
        if self.n:
            for k, at in self._by_window(np.maximum(np.searchsorted(self.first, x, side="left") - 1, 0)):
                out[at] = np.searchsorted(self._window(k), x[at], side="left") + k * self.WINDOW
        return np.clip(out, lo, hi)


class Level:
    """Children of ``parents`` numbered nodes: pointers to where each one's values begin, and the values, made monotone."""

    @staticmethod
    def code(parents: int, parent: np.ndarray, value: np.ndarray) -> list[tuple]:
        """Sorted by parent, then value."""
        pointers = np.searchsorted(parent, np.arange(parents + 1))
        has = np.flatnonzero(np.diff(pointers))
        last = value[pointers[has + 1] - 1] + 1
        relative = value + np.repeat(np.cumsum(last) - last, np.diff(pointers)[has])
        return [EliasFano.code(pointers), EliasFano.code(relative)]

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    def find(self, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place of each value below its parent, -1 where it isn't; a parent of -1 has none."""
        out = np.full(len(parent), -1, dtype=np.int64)
        live = np.flatnonzero(parent >= 0)
        lo, hi = self.pointers.get(parent[live]), self.pointers.get(parent[live] + 1)
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        if len(live):
            before = np.zeros(len(live), dtype=np.int64)
            before[lo > 0] = self.values.get(lo[lo > 0] - 1) + 1
            x = value[live] + before
            k = self.values.successor(x, lo, hi)
            met = k < hi
            met[met] = self.values.get(k[met]) == x[met]
            out[live[met]] = k[met]
        return out


class Trie:
    """Levels and codes in one anonymous memory mapping. Levels come as (parents, parent of each, value of each), codes as bytes."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], codes: list[np.ndarray]):
        coded = [part for level in levels for part in Level.code(*level)]
        arrays = [x for part in coded for x in part[2:]] + [c.astype(np.uint8) for c in codes]
        places, size = [], 0
        for x in arrays:
            places.append(size)
            size += -(-x.nbytes // 8) * 8
        self.bytes = size
        self.map = mmap.mmap(-1, max(8, size))
        whole = np.frombuffer(self.map, dtype=np.uint8)
        held = []
        for x, at in zip(arrays, places, strict=True):
            whole[at : at + x.nbytes] = x.view(np.uint8)
            held.append(whole[at : at + x.nbytes].view(x.dtype))
        sequences = [EliasFano(part[0], part[1], *held[3 * i : 3 * i + 3]) for i, part in enumerate(coded)]
        self.levels = [Level(*sequences[i : i + 2]) for i in range(0, len(sequences), 2)]
        self.codes = held[3 * len(coded) :]

    def code(self, k: int, place: np.ndarray) -> np.ndarray:
        """The k-th level's codes at these places, 0 for -1."""
        out = np.zeros(len(place), dtype=np.uint8)
        out[place >= 0] = self.codes[k][place[place >= 0]]
        return out


def steps_for(p: np.ndarray) -> float:
    """Codes to a power of ten: 32, or as many as take the smallest probability in."""
    least = float(p.min()) if len(p) else 1.0
    return min(32.0, 254 / -np.log10(least)) if least < 1 else 32.0


def quantise(p: np.ndarray, steps: float = 32.0) -> np.ndarray:
    """Codes 1 to 255 for probabilities, in steps of a 32nd of log10 or as given; 0 means none."""
    return np.clip(np.rint(255 + steps * np.log10(p)), 1, 255).astype(np.uint8)


def expand(code: np.ndarray, steps: float = 32.0) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 255) / steps), 0.0)


# ---- payloads --------------------------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> np.ndarray:
    """Bytes of equal weight together: the upper ones of small numbers are all zero and take no room compressed."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).ravel()


def _squeeze(k: int, *arrays: np.ndarray) -> bytes:
    """A compressed pack() of stretch ``k``, integers by planes: runs, counts and codes are mostly small."""
    data = pack(*((_planes(np.ascontiguousarray(a)) if a.dtype.kind != "f" else a) for a in arrays))
    kinds = b"".join(a.dtype.str[1:].encode() for a in arrays)
    return k.to_bytes(4, "little") + len(data).to_bytes(8, "little") + bytes([len(kinds)]) + kinds + _ZSTD.compress(data, asbytes=True)


def _expanded(data: bytes) -> list[np.ndarray]:
    n = data[12]
    arrays = unpack(_ZSTD.decompress(memoryview(data)[13 + n :], int.from_bytes(data[4:12], "little"), asbytes=True))
    out = []
    for i, a in enumerate(arrays):
        kind = np.dtype("<" + data[13 + 2 * i : 15 + 2 * i].decode())
        out.append(a if kind.kind == "f" else np.ascontiguousarray(a.reshape(kind.itemsize, -1).T).view(kind).ravel() if kind.itemsize > 1 else a.view(kind))
    return out


def _stretch_of(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


# ---- stretches of a block --------------------------------------------------------------------------------------------------------


class Stretch:
    """Tokens of some documents of a block: numbers of words among the stretch's distinct ones, and the two words before each."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        self.rows, self.sizes, self.train = at, sizes, train
        self.words, token = np.unique(np.concatenate((hashes, [START])), return_inverse=True)
        token = token.astype(np.int32)
        start = self.start = int(token[-1])
        self.token = token[:-1]
        self.known = np.repeat(train, sizes)
        self.before = np.concatenate((token[-1:], self.token[:-1]))
        self.before[np.cumsum(sizes)[:-1]] = start

    def counts(self) -> np.ndarray:
        return np.bincount(self.token, self.known, len(self.words)).astype(np.uint32)


def stretches(table: pa.Table, size: int) -> Iterator[Stretch]:
    """The rows of a block in the order of their row numbers, in stretches of about ``size`` tokens: the same ones every time."""
    order = np.argsort(table.column("row").to_numpy())
    lens = pc.binary_length(table.column("text")).to_numpy()[order]
    text, train = table.column("text").combine_chunks(), table.column("more_0").to_numpy(zero_copy_only=False)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = at = 0

    def done() -> Stretch:
        rows = np.concatenate([x[0] for x in held])
        return Stretch(rows, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), train[rows])

    while at < len(order):
        end = max(at + 1, min(at + 4096, at + int(np.searchsorted(np.cumsum(lens[at : at + 4096]), _PIECE, side="right"))))
        rows = order[at:end]
        h, counts = word_hashes([x.translate(LOWER) for x in text.take(pa.array(rows)).to_pylist()])
        h = np.insert(h, np.cumsum(counts), END)
        held.append((rows, h, counts + 1))
        n += len(h)
        at = end
        if n >= size:
            stretch = done()
            held, n = [], 0
            yield stretch
            del stretch
    if held:
        yield done()


def _none_sent() -> pa.Table:
    return pa.Table.from_batches([packed_batch([])])


def _send_words(shards: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        block, out = table.column("block")[0].as_py(), []
        for k, s in enumerate(stretches(table, size)):
            for shard, (h, c) in by_shard(shard_of(s.words, shards), s.words, s.counts()):
                out.append((shard, block, _squeeze(k, h, c)))
        return pa.Table.from_batches([packed_batch(out)])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if int(x.max(initial=0)) < 1 << 32 else x


def _count_words(shards: int):
    """Each word's training count, and a number that no other word has (0: never met in training). Also the shard's sums."""

    def run(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        parts = [(b, _stretch_of(p), *_expanded(p)) for b, p in rows]
        words, at = np.unique(np.concatenate([x[2] for x in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[3] for x in parts]), len(words)).astype(np.int64)
        shard = int(shard_of(words[:1], shards)[0])
        number = np.zeros(len(words), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = 1 + np.arange(len(words)) * shards + shard  # frequent words have small numbers
        number[total == 0] = 0
        start = 0
        for b, k, h, _ in parts:
            here = at[start : start + len(h)]
            start += len(h)
            yield b, _squeeze(k, _narrow(total[here]), _narrow(number[here]))
        # The start of texts is sent as a word, but never as a token.
        yield -1, b"".join(int(x).to_bytes(8, "big") for x in (total.sum(), (total > 0).sum(), total.max(initial=0)))

    return run


def _by_stretch(answers: list[tuple[int, bytes]]) -> dict[int, list[bytes]]:
    """Answers of each stretch, in shard order, still compressed."""
    out: dict[int, list[bytes]] = {}
    for _, p in answers:
        out.setdefault(_stretch_of(p), []).append(p)
    return out


class Asked:
    """A stretch's distinct triples, in the order they are sent, and the places of its tokens among them.

    ``number`` and ``count`` are of each word; a word that training never met has the number NONE.
    """

    def __init__(self, s: Stretch, answers: list[bytes], shards: int, hot: int, order: int):
        parts = [_expanded(p) for p in answers]
        turn = np.argsort(shard_of(s.words, shards), kind="stable")
        self.count, self.number = np.empty(len(s.words), dtype=np.int64), np.empty(len(s.words), dtype=np.int64)
        self.count[turn] = np.concatenate([p[0] for p in parts])
        self.number[turn] = np.concatenate([p[1] for p in parts])
        self.number[self.count == 0] = NONE
        self.tokens = self.count.copy()  # the start is no token
        self.number[s.start] = _START_NUMBER
        self.count[s.start] = self.count[np.searchsorted(s.words, END)]  # as many starts as ends
        self.s, self.shards, self.hot = s, shards, hot
        n = len(s.words) + 1
        two = np.concatenate((np.array([n - 1], dtype=np.int32), s.before[:-1]))
        two[s.before == s.start] = n - 1
        two[np.append(self.number, NONE)[two] == NONE] = n - 1
        if order == 2:
            two[:] = n - 1
        self.where = np.flatnonzero(self.count[s.before] > 0).astype(np.int32)  # after other words, a token has its base probability
        key = s.before[self.where] * np.int64(n) + two[self.where]
        del two
        contexts = None
        if n >= 1 << 21:  # one very long text: three such numbers don't fit into 63 bits
            contexts, key = np.unique(key, return_inverse=True)
        token = s.token[self.where]
        # A word that training never met is asked for its context only.
        key *= n
        key += np.where(self.tokens[token] > 0, token + 1, 0)
        del token
        key, at = np.unique(key, return_inverse=True)
        at = at.astype(np.int32)
        times = np.bincount(at, s.known[self.where], len(key)).astype(np.uint32)
        word = (key % n - 1).astype(np.int32)
        key //= n
        if contexts is not None:
            key = contexts[key]
        last, two = (key // n).astype(np.int32), (key % n).astype(np.int32)
        del key
        self.parts = 1 + self.count // hot
        sub = np.zeros(len(last), dtype=np.uint64)
        deal = np.flatnonzero(self.parts[last] > 1)
        sub[deal] = (mix(np.append(s.words, U(0))[two[deal]]) >> U(7)) % self.parts[last[deal]].astype(np.uint64)
        shard = self._shard(last, sub)
        del sub
        turn = np.argsort(shard, kind="stable")  # the keys are in order already
        self.shard, self.last, self.two, self.word, self.times = shard[turn], last[turn], two[turn], word[turn], times[turn]
        place = np.empty(len(turn), dtype=np.int32)
        place[turn] = np.arange(len(turn), dtype=np.int32)
        self.at = place[at]

    def _shard(self, last: np.ndarray, sub: np.ndarray) -> np.ndarray:
        return shard_of(mix(self.s.words[last] + (sub.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)), self.shards).astype(np.int32)

    def messages(self, k: int, block: int) -> Iterator[tuple[int, int, bytes]]:
        if not len(self.shard):
            return
        new_shard = np.concatenate(([True], self.shard[1:] != self.shard[:-1]))
        new_last = new_shard | np.concatenate(([True], self.last[1:] != self.last[:-1]))
        new_two = new_last | np.concatenate(([True], self.two[1:] != self.two[:-1]))
        two_number = np.append(self.number, NONE)
        for a, z in zip(np.flatnonzero(new_shard).tolist(), [*np.flatnonzero(new_shard)[1:].tolist(), len(self.shard)], strict=True):
            lasts, twos = np.flatnonzero(new_last[a:z]), np.flatnonzero(new_two[a:z])
            real = self.word[a:z] >= 0
            n_two = np.diff(np.append(np.searchsorted(twos, lasts), len(twos)))
            n_word = np.add.reduceat(real, twos).astype(np.uint32)
            last, word = self.last[a:z][lasts], self.word[a:z][real]
            two = two_number[self.two[a:z][twos]]
            two = np.where(two == NONE, 0, two + 1)  # 0: none
            yield int(self.shard[a]), block, _squeeze(
                k, _narrow(self.number[last]), (self.parts[last] > 1).astype(np.uint8), n_two.astype(np.uint32),
                _narrow(two), n_word, _narrow(self.number[word]), self.times[a:z][real],
            )

    def told(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each triple: discounted probability and weight of the rest after the last word, and after both."""
        seen, rest, seen_two, rest_two = (np.zeros(len(self.shard)) for _ in range(4))
        edges = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1)).tolist()
        for a, z, data in zip(edges[:-1], edges[1:], answers, strict=True):
            code2, code3, kinds, kinds_two, met, steps = _expanded(data)
            real = self.word[a:z] >= 0
            last, two = self.last[a:z], self.two[a:z]
            new_last = np.concatenate(([True], last[1:] != last[:-1]))
            i = np.cumsum(new_last | np.concatenate(([True], two[1:] != two[:-1]))) - 1
            seen[a:z][real] = expand(code2, steps[0])
            seen_two[a:z][real] = expand(code3, steps[1])
            rest[a:z] = DISCOUNT * kinds[np.cumsum(new_last) - 1] / self.count[last]
            rest_two[a:z] = np.where(met > 0, DISCOUNT * kinds_two / np.maximum(met, 1), 1.0)[i]
        return seen, rest, seen_two, rest_two


class Hot:
    """Pairs of a hot last word and a word, dealt by the word; every part is asked for its number of different successors."""

    def __init__(self, a: Asked):
        self.a = a
        self.rows = np.flatnonzero((a.parts[a.last] > 1) & (a.word >= 0))
        self.lasts = np.unique(a.last[a.parts[a.last] > 1])
        n = len(a.s.words)
        key, self.at = np.unique(a.last[self.rows].astype(np.int64) * n + a.word[self.rows], return_inverse=True)
        last, word = key // n, key % n
        times = np.bincount(self.at, a.times[self.rows], len(key)).astype(np.uint32)
        base = np.cumsum(a.parts[self.lasts]) - a.parts[self.lasts]
        self.owner = np.repeat(np.arange(len(self.lasts)), a.parts[self.lasts])
        sub_of = np.arange(len(self.owner)) - base[self.owner]
        shard_of_group = a._shard(self.lasts[self.owner], sub_of)
        group = base[np.searchsorted(self.lasts, last)] + ((mix(a.s.words[word]) >> U(7)) % a.parts[last].astype(np.uint64)).astype(np.int64)
        self.turn = np.lexsort((word, group, shard_of_group[group]))
        self.group_turn = np.argsort(shard_of_group, kind="stable")
        self.shard, self.sub, self.word, self.times, self.group = shard_of_group[self.group_turn], sub_of[self.group_turn], word[self.turn], times[self.turn], group
        self.runs = np.bincount(group, minlength=len(self.owner))[self.group_turn]

    def messages(self, k: int, block: int) -> Iterator[tuple[int, int, bytes]]:
        edge = np.concatenate(([0], np.cumsum(self.runs)))
        starts = np.flatnonzero(np.concatenate(([True], self.shard[1:] != self.shard[:-1]))) if len(self.shard) else np.zeros(0, dtype=np.int64)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(self.shard)], strict=False):
            last = self.lasts[self.owner[self.group_turn[a:z]]]
            p, q = edge[a], edge[z]
            yield int(self.shard[a]), block, _squeeze(
                k, _narrow(self.a.number[last]), self.sub[a:z].astype(np.uint32), self.a.count[last], self.runs[a:z].astype(np.uint32),
                _narrow(self.a.number[self.word[p:q]]), self.times[p:q],
            )

    def told(self, answers: list[bytes], seen: np.ndarray, rest: np.ndarray) -> None:
        """Fill in what the triples' shards couldn't know."""
        if not len(self.lasts):
            return
        parts = [_expanded(p) for p in answers]
        got = np.empty(len(self.turn))
        if len(self.turn):
            got[self.turn] = np.concatenate([expand(p[0], p[2][0]) for p in parts])
        seen[self.rows] = got[self.at]
        kinds = np.zeros(len(self.lasts))
        np.add.at(kinds, self.owner[self.group_turn], np.concatenate([p[1] for p in parts]))
        mine = np.flatnonzero(self.a.parts[self.a.last] > 1)
        last = self.a.last[mine]
        rest[mine] = DISCOUNT * kinds[np.searchsorted(self.lasts, last)] / self.a.count[last]


def _send(shards: int, size: int, hot: int, order: int, hot_pairs: bool):
    def run(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        if not table.num_rows:
            return _none_sent()
        block, out, told = table.column("block")[0].as_py(), [], _by_stretch(answers)
        for k, s in enumerate(stretches(table, size)):
            a = Asked(s, told[k], shards, hot, order)
            out.extend((Hot(a) if hot_pairs else a).messages(k, block))
        return pa.Table.from_batches([packed_batch(out)])

    return run


def _discounted(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (count - DISCOUNT) / np.maximum(np.maximum(total, count), 1)


def _answer_pairs(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For hot words: their successors in this part as one level, and each question looked up in it."""
    parts = [(b, _stretch_of(p), *_expanded(p)) for b, p in rows]
    lasts, group = np.unique(np.concatenate([(x[2].astype(np.uint64) << U(24)) | x[3] for x in parts]), return_inverse=True)
    total = np.zeros(len(lasts), dtype=np.int64)
    total[group] = np.concatenate([x[4] for x in parts])
    words, word = np.unique(np.concatenate([x[6] for x in parts]), return_inverse=True)
    runs = np.concatenate([x[5] for x in parts])
    key, at = np.unique((np.repeat(group, runs) << 32) | word, return_inverse=True)
    count = np.bincount(at, np.concatenate([x[7] for x in parts]), len(key))
    taught = count > 0
    parent = key >> 32
    p = _discounted(count[taught], total[parent[taught]])
    steps = steps_for(p)
    code = quantise(p, steps)
    trie = Trie([(len(lasts), parent[taught], key[taught] & 0xFFFFFFFF)], [code])
    codes = trie.code(0, trie.levels[0].find(parent, key & 0xFFFFFFFF))[at]
    kinds = np.bincount(parent[taught], minlength=len(lasts))[group]
    i = j = 0
    for b, k, name, *_, runs, _, times in parts:
        yield b, _squeeze(k, codes[j : j + len(times)], kinds[i : i + len(name)].astype(np.uint32), np.array([steps]))
        i, j = i + len(name), j + len(times)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and so on, ``count`` of them, one range after the other."""
    return np.repeat(first - (np.cumsum(count, dtype=np.int64) - count), count) + np.arange(int(count.sum()))


def _look_up(name, hot, n_two, pair, n_word, asked, times, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """A part of the trie from these triples, and each of them looked up in it; first the steps that its probabilities need.

    Words before contexts' last ones are ``name``, each with ``n_two`` of ``pair``, and each of these with ``n_word`` of ``asked``.
    """
    numbers, last = np.unique(name, return_inverse=True)
    is_hot = np.zeros(len(numbers), dtype=bool)
    is_hot[last] = hot
    two_numbers, two = np.unique(pair, return_inverse=True)
    no_two = two_numbers[0] == 0 if len(two_numbers) else False
    context, at_context = np.unique((np.repeat(last, n_two) << 32) | two, return_inverse=True)
    del two
    words, word = np.unique(asked, return_inverse=True)
    key, at = np.unique((np.repeat(at_context, n_word) << 32) | word, return_inverse=True)
    del word
    count = np.bincount(at, times, len(key)).astype(np.int64)
    taught = np.flatnonzero(count)
    value = key & 0xFFFFFFFF
    # After both words; a context without a word before is none.
    of = key >> 32
    both = taught if not no_two else taught[(context[of[taught]] & 0xFFFFFFFF) > 0]
    met = np.bincount(of[both], count[both], len(context)).astype(np.int64)
    kinds = np.bincount(of[both], minlength=len(context))
    # After the last word alone.
    single, at_single = np.unique(((context[of] >> 32) << 32) | value, return_inverse=True)
    single_count = np.bincount(at_single, count, len(single)).astype(np.int64)
    parent = single >> 32
    single_taught = np.flatnonzero((single_count > 0) & ~is_hot[parent])
    total = np.bincount(parent[single_taught], single_count[single_taught], len(numbers))
    single_kinds = np.bincount(parent[single_taught], minlength=len(numbers))
    p2 = _discounted(single_count[single_taught], total[parent[single_taught]])
    p3 = _discounted(count[both], met[of[both]])
    needed = np.array([steps_for(p2), steps_for(p3)])
    real = np.flatnonzero(met)  # contexts of two words that training met
    rank = np.cumsum(met > 0) - 1
    trie = Trie(
        [
            (1, np.zeros(len(numbers), dtype=np.int64), numbers.astype(np.int64)),
            (len(numbers), context[real] >> 32, context[real] & 0xFFFFFFFF),
            (len(real), rank[of[both]], value[both]),
            (len(numbers), parent[single_taught], single[single_taught] & 0xFFFFFFFF),
        ],
        [quantise(p3, steps[1]), quantise(p2, steps[0])],
    )
    del rank, both, taught, single_taught, p2, p3
    names, before, after, alone = trie.levels
    first = names.find(np.zeros(len(numbers), dtype=np.int64), numbers.astype(np.int64))
    second = before.find(first[context >> 32], context & 0xFFFFFFFF)
    code3 = trie.code(0, after.find(second[of], value))[at]
    code2 = trie.code(1, alone.find(first[parent], single & 0xFFFFFFFF))[at_single][at]
    return needed, code2, code3, single_kinds[last], kinds[at_context], met[at_context]


def _answer_triples(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The shard's part of the trie, from all that was sent, and each question looked up in it.

    Below different last words nothing is shared, so the work goes by groups of them, about GROUP triples at a time: arrays as long
    as all of the shard's triples are only those sent and the answers.
    """
    parts = [(b, _stretch_of(p), *_expanded(p)) for b, p in rows]
    sizes = [(b, k, len(x[0]), len(x[3]), len(x[6])) for b, k, *x in parts]
    name, hot, n_two, pair, n_word, word, times = ([x[i] for x in parts] for i in range(2, 9))
    del parts
    columns = []
    for x in (name, hot, n_two, pair, n_word, word, times):
        columns.append(np.concatenate(x))
        x.clear()
    name, hot, n_two, pair, n_word, word, times = columns
    first_pair, first_word = (np.cumsum(x, dtype=np.int64) - x for x in (n_two, n_word))
    numbers, last = np.unique(name, return_inverse=True)
    weight = np.bincount(last, np.add.reduceat(n_word, first_pair, dtype=np.int64) + n_two, len(numbers)).astype(np.int64)
    group = ((np.cumsum(weight) - weight) // GROUP)[last]
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    del numbers, last, weight, group
    code2, code3 = np.empty(len(word), dtype=np.uint8), np.empty(len(word), dtype=np.uint8)
    single_kinds, kinds, met = np.empty(len(name), dtype=np.uint32), np.empty(len(pair), dtype=np.uint32), np.empty(len(pair), dtype=np.int64)
    steps = np.full(2, 32.0)
    while True:
        needed = steps
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = order[a:z]
            j = _ranges(first_pair[i], n_two[i])
            m = _ranges(first_word[j], n_word[j])
            need, code2[m], code3[m], single_kinds[i], kinds[j], met[j] = _look_up(name[i], hot[i], n_two[i], pair[j], n_word[j], word[m], times[m], steps)
            needed = np.minimum(needed, need)
        if (needed == steps).all():
            break
        steps = needed  # a shard's codes have the same steps, those that its smallest probability needs
    i = j = m = 0
    for b, k, names, pairs, words in sizes:
        yield b, _squeeze(k, code2[m : m + words], code3[m : m + words], single_kinds[i : i + names], kinds[j : j + pairs], _narrow(met[j : j + pairs]), steps)
        i, j, m = i + names, j + pairs, m + words


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, size: int, hot: int, order: int, n: int, v: int):
    def run(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        cols = {c: np.zeros(table.num_rows, dtype=d) for c, d in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", np.float64), ("score", np.float64))}
        words, triples, pairs = (_by_stretch([x for x in answers if x[0] // shards == i]) for i in range(3))
        for k, s in enumerate(stretches(table, size) if table.num_rows else ()):
            a = Asked(s, words[k], shards, hot, order)
            h = Hot(a)
            seen, p, seen_two, rest_two = a.told(triples.get(k, []))
            h.told(pairs.get(k, []), seen, p)
            del h
            base = (np.append(a.tokens, 0) + 1.0) / (n + 1.0 * (v + 1))  # at the end, of words that training never met
            p *= base[a.word]
            p += seen
            p *= rest_two
            p += seen_two
            del seen, seen_two, rest_two
            base = base[s.token]
            each, p = p, base.copy()
            p[a.where] = each[a.at]
            del each
            doc = np.repeat(s.rows, s.sizes)
            rows = table.num_rows
            cols["n_tokens"] += np.bincount(doc, minlength=rows)
            cols["n_known"] += np.bincount(doc, a.tokens[s.token] > 0, rows).astype(np.int64)
            cols["base_score"] += np.bincount(doc, np.log10(base), rows)
            cols["score"] += np.bincount(doc, np.log10(np.minimum(p, 1.0)), rows)
        held = pc.invert(table.column("more_0"))
        return pa.table(
            [table.column("doc_id"), held, pa.array(cols["n_tokens"]), pa.array(cols["n_known"]), pa.array(np.full(table.num_rows, n)), pa.array(cols["base_score"]), pa.array(cols["score"])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def scored(docs: DataFrame, mod: int = 7, held: int = 2, hot: int = HOT, order: int = 3, stretch: int = STRETCH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): tokens, known tokens, training tokens, unigram and model log10 probability of
    ``order`` 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    train = F.coalesce(fold("doc_id", mod) != held, F.lit(False)).alias("train")
    with Blocks(docs.select("doc_id", "text", train), "train") as blocks:
        shards = blocks.shards
        words = settle(blocks.answer(blocks.emit_whole(_send_words(shards, stretch)), _count_words(shards)))
        sums = [F.expr(f"cast(conv(hex(substring(payload, {at}, 8)), 16, 10) as decimal(38, 0))") for at in (1, 9, 17)]
        total = words.where("block = -1").agg(F.sum(sums[0]), F.sum(sums[1]), F.max(sums[2])).first()
        n, v, most = (int(x or 0) for x in total)
        words = words.where("block >= 0")
        sent = "shard int, block int, payload binary"
        told = words
        triples = blocks.answer(blocks.with_answers(words, _send(shards, stretch, hot, order, False), sent), _answer_triples)
        told = told.unionByName(triples.selectExpr(f"shard + {shards} as shard", "block", "payload"))
        if most >= hot:
            pairs = blocks.answer(blocks.with_answers(words, _send(shards, stretch, hot, order, True), sent), _answer_pairs)
            told = told.unionByName(pairs.selectExpr(f"shard + {2 * shards} as shard", "block", "payload"))
        return settle(blocks.with_answers(told, _score(shards, stretch, hot, order, n, v), SCHEMA))
