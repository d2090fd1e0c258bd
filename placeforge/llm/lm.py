"""Language-model scores: hashed-context bit predictors under online logistic mixing.

A text is its A-Z lower-cased words and one end.  The stream of tokens is coded
by binary decisions:

* Where the last token, or the last two, occurred before in the document, a
  first decision says whether the token is again the one that followed there.
* If not, the token's symbol is coded bit by bit.  The most frequent words and
  the end are symbols of their own; other words share a symbol by their first
  two bytes.  Codes are Huffman codes by training counts.
* A word that shares its symbol costs besides what it is within the symbol: its
  training count, mixed by an escape chance with its spelling, byte by byte.

Each decision is predicted by the node's own counts and by counts in hashed
contexts that cross words (the last token, the last two, the last two frequent
ones).  Their log-odds are combined by weights that a gate selects (depth, and
how well the contexts are known); the weights are learned online, block after
block, and an adaptive table refines the mixed probability.  The spelling has a
mixer of the same kind over the position and the last one to five bytes.

A document outside the held-out fold is learned from, so when it is scored the
predictors leave one count of its own out.  A score is a proper code length;
``bits_per_byte`` follows.

1. ``encode``: documents become word numbers of their chunk of text, in order;
   a chunk's dictionary goes out in parts by the words' hash.
2. The parts are merged to the corpus' words and training counts.
3. The spelling is learned from the words, each once; words are priced and sent
   back to their chunks, where documents become symbols (``resolve``).
4. The contexts' counts are summed over all training documents, in tables that
   grow with the tokens up to ``MOST_BITS``; the mixer learns from all of them;
   then every document is scored.

Both mixers learn online over shards, which together hold all training words or
documents; the shards' weights are merged by their curvatures (``Mixer.merged``).
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeforge.llm.common import drop_table, materialise

END = b"\n"
#: A chunk closes at so many distinct words or characters; bytes of text for each part of the dictionary; words
#: learned at once; bytes of text read at once for each word that closes a chunk.
CHUNK_WORDS, CHUNK_CHARS, PART_BYTES, BLOCK_WORDS, WORD_BYTES = 400_000, 40_000_000, 32 << 20, 1 << 16, 25
#: Words with a symbol of their own, and how often they come at least (rarer ones tell how new words are spelled);
#: symbols by first bytes; frequent words among the contexts.
OWN_SYMBOLS, OWN_COUNT, SHARED_SYMBOLS, FREQUENT = 4096, 8, 1024, 64
#: Tasks that sum tables: at least, and the tokens for each of more; from how many on they add in lanes first.
TRAINERS, TRAINER_TOKENS, LANES_FROM = 6, 20_000_000, 16
#: Words and tokens that the mixers learn from at a time, at first and at most (as many as they have read, or an
#: eighth); tokens of a shard, at least.
ONLINE_WORDS, ONLINE_TOKENS, SHARD_TOKENS = (8192, 1 << 16, 1), (2048, 1 << 15, 8), 200_000
#: Tokens flagged, counted or scored at a time.
STREAM_TOKENS = (1 << 15, 1 << 15, 1)
#: Words longer than this are coded in segments, which go on with the last bytes.
SEGMENT = 40
#: Bits of each spelling context's table: position, the last one to five bytes.
TABLE_BITS = (12, 17, 19, 20, 21, 22)
ORDERS = len(TABLE_BITS)
POSITIONS, LEVELS, PRIOR, BINS = 4, 5, 0.3, 33
#: Bytes carried over from one segment to the next.
CARRY = 5
#: Contexts of the stream; its gates; levels of knowledge; bits of each context's table.
CONTEXTS, GATES, STREAM_LEVELS, LEAST_BITS, MOST_BITS = 3, 16, 6, 18, 22
_STARTS = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))
SLOTS = int(_STARTS[-1])
_SHIFTS, _FIRSTS = np.array([[64 - b] for b in TABLE_BITS], np.uint64), _STARTS[:-1, None].astype(np.uint64)
_PHI, _MIX, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


class Block:
    """Sorted distinct words as rows of bytes; calls back for each decision of each distinct prefix."""

    def __init__(self, words: list[bytes], counts: np.ndarray | None = None):
        coded = [w if w == END else w + b" " for w in words]
        rows, owner, history, lens, first = [], [], [], [], []
        for k, w in enumerate(coded):
            if len(w) <= SEGMENT:
                rows.append(w)
                owner.append(k)
                first.append(True)
        long = [k for k, w in enumerate(coded) if len(w) > SEGMENT]
        n = len(rows)
        for k in long:
            w = coded[k]
            for a in range(0, len(w), SEGMENT):
                rows.append(w[a : a + SEGMENT])
                owner.append(k)
                first.append(a == 0)
                history.append(w[a - CARRY : a] if a else bytes(CARRY))
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        self.width = int(lens.max(initial=0))
        flat = b"".join([r.ljust(self.width, b"\0") for r in rows])
        before = np.zeros((len(rows), CARRY), np.uint8)
        if history:
            before[n:] = np.frombuffer(b"".join(history), np.uint8).reshape(-1, CARRY)
        self.bytes = np.hstack([before, np.frombuffer(flat, np.uint8).reshape(len(rows), self.width)])
        self.lens, self.owner, self.words, self.first = lens, np.array(owner, np.int64), len(words), np.array(first, bool)
        self.counts = None if counts is None else counts[self.owner].astype(np.float64)
        own = self.bytes[:, CARRY:]
        same = np.zeros(len(rows), np.int64)
        if len(rows) > 1:
            same[1:] = np.logical_and.accumulate(own[1:] == own[:-1], axis=1).sum(axis=1)
        same[n:] = 0
        self.same = same

    def events(self) -> Iterator[tuple]:
        """(j, bit, rows, slots (orders x rows), bits, weights) of each decision, a row for each distinct prefix."""
        for j in range(self.width):
            starts = np.flatnonzero(self.same <= j)
            rows = starts[self.lens[starts] > j]
            if not len(rows):
                break
            weight = None
            if self.counts is not None:
                weight = np.add.reduceat(self.counts, starts)[self.lens[starts] > j]
            last = [self.bytes[rows, j + CARRY - k].astype(np.uint64) for k in range(1, CARRY + 1)]
            contexts = [np.full(len(rows), min(j, 3), np.uint64), last[0]]
            for k in range(1, CARRY):
                contexts.append(contexts[-1] | (last[k] << np.uint64(8 * k)))
            base = np.stack([(c + np.uint64(o + 1)) * _PHI for o, c in enumerate(contexts)])
            byte = self.bytes[rows, j + CARRY]
            node = np.ones(len(rows), np.uint64)
            for bit in range(8):
                now = (byte >> (7 - bit)) & 1
                slots = base ^ (node * _NODE)
                slots *= _MIX
                slots >>= _SHIFTS
                slots += _FIRSTS
                yield j, bit, rows, slots.view(np.int64), now, weight
                node = (node << np.uint64(1)) | now.astype(np.uint64)

    def spread(self, j: int, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values of the rows' prefixes for all rows that share them; 0 for shorter words."""
        full = np.zeros(len(self.lens))
        full[rows] = value
        leader = np.maximum.accumulate(np.where(self.same <= j, np.arange(len(self.lens)), 0))
        return np.where(self.lens > j, full[leader], 0.0)


def squash(x: np.ndarray) -> np.ndarray:
    p = np.clip(x, -12.0, 12.0)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1.0
    return np.divide(1.0, p, out=p)


class Mixer:
    """Weights by gate and level, and the refining tables."""

    def __init__(self, gates: int, levels: int, inputs: int) -> None:
        self.shape = gates, levels, inputs
        self.weights = np.full((gates, levels, inputs + 1), 1.0 / inputs)
        self.weights[..., -1] = 0.0
        self.ones = np.zeros((gates, levels, BINS))
        self.seen = np.zeros((gates, levels, BINS))
        self.curves = np.tile(np.eye(inputs + 1), (gates, levels, 1, 1))

    def mixed(self, gate: int, level: np.ndarray, odds: list[np.ndarray], kind: type = np.float64) -> np.ndarray:
        """Log-odds from the inputs; the last weight is the constant."""
        w = self.weights[gate].astype(kind)
        z = w[:, -1].take(level)
        for k, x in enumerate(odds):
            z += w[:, k].take(level) * x
        return z

    def learn(self, gate: int, level: np.ndarray, odds: list[np.ndarray], now: np.ndarray) -> None:
        """A block of decisions is predicted, refines the table, and then moves the weights.

        The weights take an online Newton step: the block's gradient in the
        curvature of all blocks so far.
        """
        w, levels = self.weights[gate], self.shape[1]
        order = np.argsort(level.astype(np.uint8), kind="stable")  # by radix: a level's decisions lie together
        ends = np.cumsum(np.bincount(level, minlength=levels)).tolist()
        spans = [(v, a, b) for v, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
        # a block's sums in single precision, the weights and curvatures in double
        x, z, y = np.empty((len(odds) + 1, len(order)), np.float32), np.empty(len(order), np.float32), now.take(order).astype(np.int64)
        for k, o in enumerate(odds):
            x[k] = o.take(order)
        x[-1] = 1.0
        for v, a, b in spans:
            np.matmul(w[v].astype(np.float32), x[:, a:b], out=z[a:b])
        at = self._bin(z)
        at <<= 1
        at += y
        p = squash(z)
        rest = y.astype(np.float32) - p
        bend = p * (1 - p)
        np.maximum(bend, np.float32(1e-4), out=bend)
        pull = np.zeros((levels, len(x)))
        for v, a, b in spans:
            tally = np.bincount(at[a:b], minlength=2 * BINS).reshape(BINS, 2)
            self.ones[gate, v] += tally[:, 1]
            self.seen[gate, v] += tally.sum(axis=1)
            part = x[:, a:b]
            pull[v] = part @ rest[a:b]
            self.curves[gate, v] += (part * bend[a:b]) @ part.T
        w += np.clip(np.linalg.solve(self.curves[gate], pull[..., None])[..., 0], -0.5, 0.5)

    def sums(self) -> np.ndarray:
        """What a shard has learned, as numbers that add up over shards."""
        curves = self.curves - np.eye(self.weights.shape[-1])
        pull = (self.curves @ self.weights[..., None])[..., 0] - Mixer(*self.shape).weights
        return np.concatenate([x.ravel() for x in (curves, pull, self.ones, self.seen)])

    @classmethod
    def merged(cls, total: np.ndarray, gates: int, levels: int, inputs: int) -> Mixer:
        """The mixer of all shards: each one's weights count by its curvature, what none has met stays."""
        out, at = cls(gates, levels, inputs), 0
        pull = np.zeros_like(out.weights)
        for x in (out.curves, pull, out.ones, out.seen) if len(total) else ():
            x += total[at : at + x.size].reshape(x.shape)
            at += x.size
        out.weights = np.linalg.solve(out.curves, (out.weights + pull)[..., None])[..., 0]
        return out

    @staticmethod
    def _bin(z: np.ndarray) -> np.ndarray:
        at = np.clip(z, -8.0, 8.0)
        at += 8.0
        at *= (BINS - 1) / 16.0
        return np.rint(at, out=at).astype(np.int64)

    def refined(self, gate: int, level: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean, in log-odds, of the mixed and the table's."""
        centre = squash(np.linspace(-8.0, 8.0, BINS))
        table = (self.ones[gate] + 20.0 * centre) / (self.seen[gate] + 20.0)
        p = np.clip(table, 1e-5, 1 - 1e-5)
        odds = np.log(p / (1 - p))
        rise = np.diff(odds, axis=1, append=odds[:, -1:]).ravel()
        at = np.clip(z, -8.0, 8.0)
        at += 8.0
        at *= (BINS - 1) / 16.0
        low = at.astype(np.int64)
        at -= low
        low += level * BINS
        at *= rise.take(low)
        at += odds.ravel().take(low)
        at += z
        at /= 2
        return squash(at)

    #: Log-odds from -12 to 12 in so many steps.
    STEPS = 24 * 64

    def costs(self, gate: int) -> np.ndarray:
        """log10 of the refined probability by level, step of the mixed log-odds, and bit: a flat table."""
        levels = self.weights.shape[1]
        z = np.tile(np.linspace(-12.0, 12.0, self.STEPS + 1), levels)
        p = self.refined(gate, np.repeat(np.arange(levels), self.STEPS + 1), z)
        return np.stack([np.log10(1.0 - p), np.log10(p)], axis=1).astype(np.float32).ravel()


# -- spelling -----------------------------------------------------------------


def _gate(j: int, bit: int) -> int:
    return min(j, POSITIONS - 1) * 8 + bit


def _level(total: np.ndarray) -> np.ndarray:
    """From the longest contexts' counts: how long a context is known, and how well the longest one."""
    level = (total[-1] > 3.5).astype(np.int64)
    for x in total[-3:]:
        level += x > 0.5
    return level


def count_block(block: Block, table: np.ndarray) -> None:
    """Adds the block's decisions to the counts, table[slot, bit]."""
    flat = table.reshape(-1)
    for _, _, _, slots, now, weight in block.events():
        slots <<= 1
        slots += now
        weight = weight.astype(flat.dtype)
        for o in range(ORDERS):
            np.add.at(flat, slots[o], weight)


def learn_block(block: Block, table: np.ndarray, mixer: Mixer) -> None:
    """Each word is predicted without itself; what shares its prefixes stays."""
    pairs = np.ascontiguousarray(table, "<u4").view("<u8").reshape(-1)  # both counts at once
    for j, bit, _, slots, now, _ in block.events():
        held = pairs.take(slots).view("<u4").reshape(*slots.shape, 2)
        n0, n1 = (held[..., k].astype(np.float32) for k in (0, 1))
        n1 -= now
        n0 -= now == 0
        for n in (n0, n1):
            np.maximum(n, 0, out=n)
        level = _level(n0[-3:] + n1[-3:])
        n1 += np.float32(PRIOR)
        n0 += np.float32(PRIOR)
        n1 /= n0
        mixer.learn(_gate(j, bit), level, list(np.log(n1, out=n1)), now)


def score_block(block: Block, odds: np.ndarray, known: np.ndarray, mixer: Mixer, given: np.ndarray) -> np.ndarray:
    """log10 probability of each word of the block after its first ``given`` bytes, which are known."""
    total = np.zeros(len(block.lens))
    after = np.where(block.first, given[block.owner], 0)
    cost = None
    for j, bit, rows, slots, now, _ in block.events():
        if bit == 0:
            cost = np.zeros(len(rows))
        level = _level(known.take(slots[-3:]))
        p = mixer.refined(_gate(j, bit), level, mixer.mixed(_gate(j, bit), level, list(odds.take(slots))))
        np.subtract(1.0, p, out=p, where=now == 0)
        cost += np.log10(p, out=p)
        if bit == 7:
            total += np.where(j >= after, block.spread(j, rows, cost), 0.0)
    return np.bincount(block.owner, total, block.words) if len(total) else np.zeros(block.words)


# -- symbols ------------------------------------------------------------------


def shared_class(word: bytes) -> bytes:
    """The first two bytes of a word that is closed by a space."""
    return word[:2].ljust(2, b" ")


class Symbols:
    """Symbols of words and their Huffman codes; the last symbol is that of all other words."""

    def __init__(self, own: list[tuple[bytes, int]], shared: dict[bytes, tuple[int, int]], other: tuple[int, int]):
        """own: (word, count), by count; shared: first bytes to (count of tokens, words seen once); other: the same of the rest."""
        if END not in (w for w, _ in own):
            own = [*own, (END, 0)]
        self.of_word = {w: k for k, (w, _) in enumerate(own)}
        self.of_class = {c: len(own) + k for k, c in enumerate(shared)}
        self.own, self.size = len(own), len(own) + len(shared) + 1
        mass = np.array([*shared.values(), other], np.float64).reshape(-1, 2)
        self.mass, self.escape = mass[:, 0], np.where(mass[:, 0] > 0, (mass[:, 1] + 0.5) / (mass[:, 0] + 1.0), 1.0)
        self._code(np.concatenate([[c for _, c in own], self.mass]) + 0.5)

    def symbol(self, word: bytes) -> int:
        k = self.of_word.get(word)
        return self.of_class.get(shared_class(word), self.size - 1) if k is None else k

    def _code(self, counts: np.ndarray) -> None:
        heap = [(float(c), k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        inner: list[tuple[float, float]] = []
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            node = self.size + len(inner)
            above[x], above[y] = (node, 0), (node, 1)
            inner.append((a, b))
            heapq.heappush(heap, (a + b, node))
        paths = []
        for k in range(self.size):
            path, at = [], k
            while at in above:
                at, bit = above[at]
                path.append((at - self.size, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.uint8)
        depth = int(self.length.max(initial=0))
        odds = np.array([math.log(b / a) for a, b in inner], np.float32)
        names = (np.arange(1, len(inner) + 1, dtype=np.uint64) * _NODE) | np.uint64(1)
        self.name, self.bit = np.zeros((depth, self.size), np.uint64), np.zeros((depth, self.size), np.int64)
        self.odds = np.zeros((depth, self.size), np.float32)
        for k, path in enumerate(paths):
            for d, (node, bit) in enumerate(path):
                self.name[d, k], self.bit[d, k], self.odds[d, k] = names[node], bit, odds[node]


# -- the stream ---------------------------------------------------------------

#: Bits of a token's flag: something is predicted, it is right, by the last two tokens; then the length of the run before it.
PREDICTED, RIGHT, BY_TWO, RUN = 1, 2, 4, 8


def _before(keys: np.ndarray) -> np.ndarray:
    """The last earlier place of each place's key, or -1."""
    n = len(keys)
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = np.sort((keys & ~((np.uint64(1) << bits) - np.uint64(1))) | np.arange(n, dtype=np.uint64))
    at = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = (packed[1:] >> bits) == (packed[:-1] >> bits)
    out = np.full(n, -1, np.int64)
    out[at[1:][same]] = at[:-1][same]
    return out


def copy_flags(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The flag of each token of some documents: what followed the last tokens when they last occurred in the document."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint8)
    at = np.arange(n)
    begin = np.zeros(n, np.int64)
    begin[starts] = starts
    begin = np.maximum.accumulate(begin)
    one = np.concatenate(([0], tokens[:-1])).astype(np.uint64)
    two = np.concatenate(([0, 0], tokens[:-2]))[:n].astype(np.uint64)
    own = begin.astype(np.uint64) * _NODE
    key = ((one + np.uint64(1)) * _PHI) ^ own
    key = (key ^ (key >> np.uint64(29))) * _MIX
    wide = (key ^ ((two + np.uint64(3)) * _NODE)) * _PHI
    wide = (wide ^ (wide >> np.uint64(31))) * _MIX
    # a document's first tokens have no context: no two of them are alike
    first, second = at == begin, at <= begin + 1
    key[first] = at[first].astype(np.uint64) * _PHI
    wide[second] = at[second].astype(np.uint64) * _PHI
    by_one, by_two = _before(key), _before(wide)
    by_one[(by_one < begin) | first], by_two[(by_two < begin) | second] = -1, -1
    source = np.where(by_two >= 0, by_two, by_one)
    given = source >= 0
    right = given & (tokens[source] == tokens)
    missed = np.maximum.accumulate(np.where(right, begin - 1, at))
    run = np.minimum(at - 1 - np.concatenate(([-1], missed[:-1])), 7)
    run = np.where(first, 0, run)
    return (given * PREDICTED + right * RIGHT + (by_two >= 0) * BY_TWO + run * RUN).astype(np.uint8)


def _code_counts(n: np.ndarray) -> np.ndarray:
    """Counts in six bits: exact to 31, then by quarters of doublings."""
    large = 32 + np.floor(4 * np.log2(np.maximum(n, 32) / 32.0))
    return np.where(n < 32, n, np.minimum(large, 63)).astype(np.uint16)


def pack_states(table: np.ndarray) -> np.ndarray:
    """Counts [slot, bit] as one number each."""
    return _code_counts(table[:, 0]) | (_code_counts(table[:, 1]) << np.uint16(6))


def _state_tables() -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and knowledge (0 none, 1 little, 2 more) by state: plain, without a zero, without a one."""
    code = np.arange(64)
    value = np.where(code < 32, code, 32 * 2.0 ** ((code - 32) / 4))
    n0, n1 = np.tile(value, 64), np.repeat(value, 64)
    pairs = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    odds = np.concatenate([np.log((b + PRIOR) / (a + PRIOR)) for a, b in pairs]).astype(np.float32)
    known = np.concatenate([(a + b > 0.5).astype(np.int64) + (a + b > 3.5) for a, b in pairs])
    return odds, known


_STATE_ODDS, _STATE_KNOWN = _state_tables()
_STATE_ANY = 3 * (_STATE_KNOWN > 0)


class Stream:
    """The decisions of some documents' tokens."""

    def __init__(self, syms: np.ndarray, flags: np.ndarray, starts: np.ndarray, symbols: Symbols, bits: int):
        n = len(syms)
        at = np.arange(n)
        begin = np.zeros(n, np.int64)
        begin[starts] = starts
        begin = np.maximum.accumulate(begin) if n else begin
        none = symbols.size
        syms = syms.astype(np.int64)
        one = np.where(at > begin, np.concatenate(([0], syms[:-1]))[:n], none)
        two = np.where(at > begin + 1, np.concatenate(([0, 0], syms[:-2]))[:n], none)
        # places of the last frequent tokens before
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(syms < FREQUENT, at, -1))[:-1]))[:n] if n else at
        last2 = np.where(last >= begin, last[np.maximum(last, 0)], -1)
        f1 = np.where(last >= begin, syms[np.maximum(last, 0)], none)
        f2 = np.where(last2 >= begin, syms[np.maximum(last2, 0)], none)
        u = lambda x: x.astype(np.uint64)
        self.contexts = [(u(one) + np.uint64(1)) * _PHI, (u(one) + np.uint64(1)) * _MIX ^ (u(two) + np.uint64(2)) * _PHI, (u(f1) + np.uint64(3)) * _NODE ^ (u(f2) + np.uint64(4)) * _MIX]
        self.contexts = [c ^ (c >> np.uint64(32)) for c in self.contexts]
        self.syms, self.flags, self.symbols, self.shift = syms, flags, symbols, np.uint64(64 - bits)

    def _slots(self, contexts: list[np.ndarray], name: np.ndarray) -> list[np.ndarray]:
        out = []
        for c in contexts:
            slot = c ^ name
            slot *= _PHI
            slot >>= self.shift
            out.append(slot.view(np.int64))
        return out

    def events(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """(gate, tokens, slots by context, bit, the node's own log-odds) of the decisions."""
        asked = np.flatnonzero(self.flags & PREDICTED)
        if len(asked):
            flags = self.flags[asked]
            how = (flags & ~np.uint8(RIGHT)).astype(np.uint64) * _NODE
            contexts = [self.contexts[0][asked], self.contexts[2][asked], np.zeros(len(asked), np.uint64)]
            yield 0, asked, self._slots(contexts, how), ((flags & RIGHT) > 0).astype(np.int64), np.zeros(len(asked), np.float32)
        coded = np.flatnonzero((self.flags & RIGHT) == 0)
        length = self.symbols.length[self.syms[coded]]
        order = np.argsort(np.uint8(255) - length, kind="stable")  # the longest codes first
        coded, length = coded[order], length[order]
        syms, contexts = self.syms[coded], [c[coded] for c in self.contexts]
        left = np.cumsum(np.bincount(length, minlength=self.symbols.length.max() + 1)[::-1])[::-1]
        for d in range(len(self.symbols.name)):
            n = int(left[d + 1])
            if not n:
                break
            s = syms[:n]
            name = self.symbols.name[d].take(s)
            yield 1 + min(d, GATES - 2), coded[:n], self._slots([c[:n] for c in contexts], name), self.symbols.bit[d].take(s), self.symbols.odds[d].take(s)

    def inputs(self, event: tuple, states: list[np.ndarray], own: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Level and inputs of an event; ``own``: the documents' own counts are left out."""
        _, _, slots, bit, node = event
        held = [t.take(s).astype(np.int64) for t, s in zip(states, slots, strict=True)]
        if own:
            base = (bit + 1) << 12
            for h in held:
                h += base
        level = _STATE_KNOWN.take(held[1])
        level += _STATE_ANY.take(held[2])
        return level, [node, *(_STATE_ODDS.take(h) for h in held)]


def count_stream(stream: Stream, tables: np.ndarray) -> None:
    """Adds the decisions to the counts, tables[context, slot, bit]."""
    for _, _, slots, bit, _ in stream.events():
        for k, s in enumerate(slots):
            s <<= 1
            s += bit
            np.add.at(tables[k].reshape(-1), s, np.uint32(1))


def learn_stream(stream: Stream, states: list[np.ndarray], mixer: Mixer) -> None:
    for event in stream.events():
        level, odds = stream.inputs(event, states, True)
        mixer.learn(event[0], level, odds, event[3])


def score_stream(stream: Stream, states: list[np.ndarray], mixer: Mixer, costs: list[np.ndarray], own: bool) -> np.ndarray:
    """log10 probability of each token's decisions."""
    total, coded, sums = np.zeros(len(stream.syms)), None, None
    for event in stream.events():
        gate, tokens, _, bit, _ = event
        level, odds = stream.inputs(event, states, own)
        z = mixer.mixed(gate, level, odds, np.float32)
        z *= 64.0
        z += 12.0 * 64.0 + 0.5
        at = np.clip(z, 0.5, Mixer.STEPS + 0.5, out=z).astype(np.int64)
        level *= Mixer.STEPS + 1
        at += level
        at <<= 1
        at += bit
        cost = costs[gate].take(at)
        if not gate:
            total[tokens] += cost
        elif coded is None:
            coded, sums = tokens, cost.astype(np.float64)
        else:  # the tokens whose codes go on are the first ones
            sums[: len(cost)] += cost
    if coded is not None:
        total[coded] += sums
    return total


# -- the corpus ---------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    """Whether crc32 of the id as text falls in the fold; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _join(words: list[bytes]) -> bytes:
    """No word holds a line feed; the end goes as an empty one."""
    return b"\n".join([b"" if w == END else w for w in words])


def _split(held: bytes) -> list[bytes]:
    return [w or END for w in held.split(b"\n")]


def _ints(held: pa.Scalar) -> np.ndarray:
    return np.frombuffer(held.as_py(), np.int32)


def _encoded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers, tokens of each text (its end included), and bytes of its words with a space or end each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # splits and folds as ``words_of`` does
    words, starts = split.flatten(), np.asarray(split.offsets)
    size = pc.binary_length(words).to_numpy()
    real = size > 0  # a text's outer spaces leave an empty word
    sums = [np.concatenate(([0], np.cumsum(x)))[starts - starts[0]] for x in (real, size)]
    tokens, size = (np.diff(x).astype(np.int64) + 1 for x in sums)
    return (words if real.all() else words.filter(pa.array(real))).dictionary_encode(), tokens, size + tokens - 1


def _one_dictionary(first: pa.Array | None, some: list[pa.DictionaryArray]) -> tuple[pa.Array, list[np.ndarray]]:
    """The first dictionary (if any), longer by the words of some, and the words' numbers in it; the first's numbers stay."""
    if first is not None:
        some = [pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), first), *some]
    if len(some) > 1:
        some = pa.chunked_array(some).unify_dictionaries().chunks
    return some[0].dictionary, [x.indices.to_numpy() for x in some[first is not None :]]


def encode(docs: DataFrame, parts: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows of two sorts: documents as word numbers of their chunk (part is null), and the chunks' dictionaries by parts."""
    kind = docs.schema["doc_id"].dataType
    ddl = f"chunk bigint, doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_bytes bigint, nums binary, part int, words binary, counts binary"
    names = ["chunk", "doc_id", "held_out", "n_tokens", "n_bytes", "nums", "part", "words", "counts"]

    most = min(CHUNK_CHARS // 4, WORD_BYTES * chunk_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, chars, distinct = TaskContext.get().partitionId() << 24, 0, 0
        # documents read at once: ids, held out, tokens, bytes; their words' numbers in the dictionary, or their words
        held, nums, found, some, ids = [], [], None, [], pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(found) + 1, np.int64)
            for (keys, out, lengths, sizes), own in zip(held, nums, strict=True):
                ends = np.cumsum(lengths)
                word, trained = np.ones(ends[-1], bool), np.repeat(~out, lengths)
                word[ends - 1] = False
                tokens = np.full(ends[-1], len(found), np.int32)
                tokens[word] = own
                counts += np.bincount(tokens[trained], minlength=len(counts))
                texts = [tokens[y - x : y].tobytes() for x, y in zip(lengths.tolist(), ends.tolist(), strict=True)]
                for a in range(0, len(keys), 1000):
                    cols = [pa.array(x[a : a + 1000], t) for x, t in zip((keys, out, lengths, sizes, texts), (ids, pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    n = len(cols[0])
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), *cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            words = [*found.cast(pa.large_binary()).to_pylist(), END]
            part_of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
            order = np.argsort(part_of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part_of[order])) + 1):
                joined = _join([words[k] for k in own.tolist()])
                cols = [pa.array([chunk], pa.int64()), pa.nulls(1, ids), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
                cols += [pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([int(part_of[own[0]])], pa.int32()), pa.array([joined], pa.binary()), pa.array([counts[own].astype(np.int32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            ids = batch.schema.field(0).type
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
                part = batch.slice(a, b - a)
                words, lengths, sizes = _encoded(part.column(2))
                held.append((part.column(0).to_pylist(), np.fromiter(map(held_out, part.column(1).to_pylist()), bool, b - a), lengths, sizes))
                some.append(words)
                chars, distinct, a = chars + int(sizes.sum()), distinct + len(words.dictionary), b
                if distinct >= chunk_words or chars >= CHUNK_CHARS:  # so many at most: texts share words
                    found, own = _one_dictionary(found, some)
                    nums, some, distinct = nums + own, [], len(found)
                if distinct >= chunk_words or chars >= CHUNK_CHARS:
                    yield from flush()
                    held, nums, found, chars, distinct, chunk = [], [], None, 0, 0, chunk + 1
        if held:
            found, own = _one_dictionary(found, some)
            nums += own
            yield from flush()

    return docs.select("doc_id", docs["doc_id"].cast("string").alias("name"), "text").mapInArrow(run, ddl)


def _merge(table: pa.Table) -> pa.Table:
    """One part of the dictionary: its words, their training counts, and each chunk's numbers with the words' places."""
    index, totals, nums, places = _Numbers(), np.zeros(1 << 16, np.int64), [], []
    for k in np.argsort(table["chunk"].to_numpy(), kind="stable").tolist():
        own = np.fromiter(map(index.__getitem__, _split(table["words"][k].as_py())), np.int32)
        while len(index) > len(totals):
            totals = np.concatenate([totals, np.zeros_like(totals)])
        totals[own] += _ints(table["counts"][k])  # a chunk's words are distinct
        nums.append(table["nums"][k].as_py())
        places.append(own.tobytes())
    totals = totals[: len(index)]
    chunks = sorted(table["chunk"].to_pylist())
    return pa.table({
        "part": pa.array([table["part"][0].as_py()], pa.int32()), "words": pa.array([_join(list(index))], pa.binary()), "totals": pa.array([totals.tobytes()], pa.binary()),
        "chunks": pa.array([chunks], pa.list_(pa.int64())), "nums": pa.array([nums], pa.list_(pa.binary())), "places": pa.array([places], pa.list_(pa.binary())),
        "n": pa.array([int(totals.sum())], pa.int64()), "v": pa.array([int((totals > 0).sum())], pa.int64()),
    })


_MERGED = "part int, words binary, totals binary, chunks array<bigint>, nums array<binary>, places array<binary>, n bigint, v bigint"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and training counts of each part's row (words, totals)."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield _split(batch.column(0)[k].as_py()), np.frombuffer(batch.column(1)[k].as_py(), np.int64)


def _choose_symbols(merged: DataFrame, n: int, own: int = OWN_SYMBOLS, shared: int = SHARED_SYMBOLS) -> Symbols:
    """The most frequent training words, ties to the lesser; and the most frequent first bytes of the others."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, totals in _parts(batches):
            at = np.flatnonzero(totals >= OWN_COUNT)
            if len(at) > own:
                at = at[totals[at] >= np.partition(totals[at], -own)[-own]]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in at.tolist()], pa.binary()), pa.array(totals[at])], ["word", "c"])

    found = merged.select("words", "totals").mapInArrow(best, "word binary, c bigint").orderBy(F.desc("c"), "word").limit(own)
    kept = [(bytes(r["word"]), r["c"]) for r in found.collect()]  # of fixed size
    chosen = {w for w, _ in kept} | {END}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, totals in _parts(batches):
            sums: dict[bytes, list[int]] = {}
            for w, c in zip(words, totals.tolist(), strict=True):
                if c and w not in chosen:
                    held = sums.setdefault(shared_class(w), [0, 0])
                    held[0] += c
                    held[1] += c == 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), *[pa.array([x[k] for x in sums.values()], pa.int64()) for k in (0, 1)]], ["class", "c", "once"])

    by_class = merged.select("words", "totals").mapInArrow(classes, "class binary, c bigint, once bigint").groupBy("class").agg(F.sum("c").alias("c"), F.sum("once").alias("once"))
    rows = [(bytes(r["class"]), r["c"], r["once"]) for r in by_class.collect()]  # two bytes each: 65,536 at most
    rows.sort(key=lambda r: (-r[1], r[0]))
    rest = rows[shared:]
    return Symbols(kept, {c: (a, b) for c, a, b in rows[:shared]}, (sum(r[1] for r in rest), sum(r[2] for r in rest)))


def _trainers(n: int) -> int:
    return max(TRAINERS, n // TRAINER_TOKENS)


def _lanes(n: int) -> int:
    return round(math.sqrt(_trainers(n))) if _trainers(n) >= LANES_FROM else 1


def _sum_parts(tables: DataFrame, slots: int, lanes: int) -> np.ndarray:
    """The sum of tables that came in parts (part, lane, held); lane by lane, then the lanes, so that no task adds many."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(0, np.uint64)
        for x in table["held"]:
            own = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            total = own.astype(np.uint64) if not len(total) else total + own
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table([pa.array([table[c][0].as_py()], pa.int32()) for c in ("part", "lane")] + [pa.array([packed], pa.binary())], ["part", "lane", "held"])

    if lanes > 1:
        tables = tables.groupBy("part", "lane").applyInArrow(add, _TABLE)
    flat = np.zeros(slots, np.uint32)
    for r in tables.groupBy("part").applyInArrow(add, _TABLE).collect():  # of bounded size
        own, at = np.frombuffer(zlib.decompress(bytes(r["held"])), np.uint32), r["part"] * _PART_SLOTS
        flat[at : at + len(own)] = own
    return flat


_TABLE = "part int, lane int, held binary"
_PART_SLOTS = 1 << 18


def _pieces(flat: np.ndarray, lanes: int) -> Iterator[pa.RecordBatch]:
    lane = TaskContext.get().partitionId() % lanes
    for k, a in enumerate(range(0, len(flat), _PART_SLOTS)):
        part = flat[a : a + _PART_SLOTS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["part", "lane", "held"])


_SUMS = "lane int, shard int, held binary"


def _next(read: int, sizes: tuple[int, int, int]) -> int:
    """How many to learn from at a time, after so many."""
    return min(sizes[1], max(sizes[0], read // sizes[2]))


def _sums_row(lane: int, shard: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([shard], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lane", "shard", "held"])


def _add_sums(sums: DataFrame, lanes: int) -> np.ndarray:
    """The sum of what shards have learned (``Mixer.sums``), lane by lane, in their order; empty without any."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = sum(np.frombuffer(x.as_py()) for x in table["held"])
        return pa.Table.from_batches([_sums_row(table["lane"][0].as_py(), 0, total)])

    if lanes > 1:
        sums = sums.groupBy("lane").applyInArrow(add, _SUMS)
    rows = sorted(sums.collect(), key=lambda r: (r["lane"], r["shard"]))  # a root of the tasks, each of fixed size
    return np.sum([np.frombuffer(bytes(r["held"])) for r in rows], axis=0) if rows else np.zeros(0)


def _learn_spelling(merged: DataFrame, symbols: Symbols, n: int) -> tuple[Broadcast, Mixer]:
    """The symbols, and the counts over all training words that share a symbol, each once, as new words come; and the mixer, learned from all of them by parts."""
    lanes, own = _lanes(n), symbols.of_word
    blocks = lambda words: (sorted(words[a : a + BLOCK_WORDS]) for a in range(0, len(words), BLOCK_WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SLOTS, 2), np.uint32)
        for words, totals in _parts(batches):
            for block in blocks([w for w, c in zip(words, totals.tolist(), strict=True) if c and w not in own]):
                count_block(Block(block, np.ones(len(block))), table)
        yield from _pieces(table.reshape(-1), lanes)

    held = merged.select("words", "totals")
    table = _sum_parts(held.coalesce(_trainers(n)).mapInArrow(count, _TABLE), SLOTS * 2, lanes).reshape(-1, 2)
    shape, sent = (POSITIONS * 8, LEVELS, ORDERS), held.sparkSession.sparkContext.broadcast((symbols, table))  # of fixed size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = sent.value[0].of_word, sent.value[1]
        total, lane = np.zeros(0), TaskContext.get().partitionId() % lanes
        for words, totals in _parts(batches):
            words = sorted((w for w, c in zip(words, totals.tolist(), strict=True) if c and w not in own), key=lambda w: (zlib.crc32(w), w))
            mixer, a = Mixer(*shape), 0
            while a < len(words):
                block = sorted(words[a : (a := a + _next(a, ONLINE_WORDS))])
                learn_block(Block(block, np.ones(len(block))), table, mixer)
            total = total + mixer.sums() if len(total) else mixer.sums()
        if len(total):
            yield _sums_row(lane, lane, total)

    mixer = Mixer.merged(_add_sums(held.coalesce(_trainers(n)).mapInArrow(learn, _SUMS), lanes), *shape)
    return sent, mixer


def _spelling_odds(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each slot, in single precision as ``learn_block`` takes them, and its count as far as levels tell it."""
    n0, odds = (table[:, k].astype(np.float32) for k in (0, 1))
    known = np.minimum(n0 + odds, np.float32(100)).astype(np.int8)
    odds += np.float32(PRIOR)
    n0 += np.float32(PRIOR)
    odds /= n0
    return np.log(odds, out=odds), known


def _price(merged: DataFrame, spelling: Broadcast, mixer: Mixer) -> DataFrame:
    """chunk, nums, syms, counts, free, own: by chunk and part, what its words are.

    ``free`` is a word's log10 probability within its symbol, ``own`` the same
    without one occurrence of it.
    """
    held = merged.sparkSession.sparkContext.broadcast(mixer)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (symbols, table), mixer = spelling.value, held.value
        odds, known = _spelling_odds(table)
        for batch in batches:
            for k in range(batch.num_rows):
                words, c = next(_parts(iter([batch.slice(k, 1)])))
                syms = np.fromiter(map(symbols.symbol, words), np.int32, len(words))
                free, own = np.zeros(len(words)), np.zeros(len(words))
                rare = np.flatnonzero(syms >= symbols.own)
                rare = rare[np.array(sorted(range(len(rare)), key=lambda i: words[rare[i]]), np.int64)]  # noqa: B023
                for a in range(0, len(rare), BLOCK_WORDS):
                    at = rare[a : a + BLOCK_WORDS]
                    of = syms[at] - symbols.own
                    spelled = score_block(Block([words[i] for i in at.tolist()]), odds, known, mixer, np.where(of == len(symbols.mass) - 1, 0, 2)) * math.log(10)
                    mass, escape, n = symbols.mass[of], symbols.escape[of], c[at]
                    with np.errstate(divide="ignore"):  # in logarithms: a long new word's chance is too small for a double
                        for out, less in ((free, 0), (own, 1)):
                            seen = np.log((1 - escape) * np.maximum(n - less, 0) / np.maximum(mass - less, 1.0))
                            out[at] = np.logaddexp(seen, np.log(escape) + spelled) / math.log(10)
                for chunk, nums, places in zip(*(batch.column(i)[k].values for i in (2, 3, 4)), strict=True):
                    p = np.frombuffer(places.as_py(), np.int32)
                    blobs = [syms[p], c[p], free[p].astype(np.float32), own[p].astype(np.float32)]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([nums.as_py()], pa.binary()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], ["chunk", "nums", "syms", "counts", "free", "own"])

    return merged.select("words", "totals", "chunks", "nums", "places").mapInArrow(run, "chunk bigint, nums binary, syms binary, counts binary, free binary, own binary")


def _resolve(docs: DataFrame, priced: DataFrame, n: int, v: int) -> DataFrame:
    """Each document's counts and base score, its symbols and flags, and what its words are within their symbols."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, n_known bigint, base_score double, within double, syms binary, flags binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nums = [_ints(x) for x in right["nums"]]
        size = sum(map(len, nums))
        at = np.concatenate(nums) if nums else np.zeros(0, np.int32)
        of = {}
        for name, dtype in (("syms", np.int32), ("counts", np.int64), ("free", np.float32), ("own", np.float32)):
            of[name] = np.zeros(size, dtype)
            if size:
                of[name][at] = np.concatenate([np.frombuffer(x.as_py(), dtype) for x in right[name]])
        base, known = np.log10((of["counts"] + 1) / (n + 1 * (v + 1))), of["counts"] > 0
        syms16 = of["syms"].astype(np.uint16)
        out = []
        lengths, own = left["n_tokens"].to_numpy(), ~left["held_out"].to_numpy(zero_copy_only=False)
        cut, a = np.cumsum(lengths), 0
        while a < left.num_rows:
            b = max(a + 1, int(np.searchsorted(cut, (cut[a - 1] if a else 0) + STREAM_TOKENS[1], "right")))
            tokens = np.concatenate([_ints(x) for x in left["nums"].slice(a, b - a)])
            starts = np.concatenate(([0], np.cumsum(lengths[a:b])[:-1]))
            flags = copy_flags(tokens, starts)
            within = np.where(np.repeat(own[a:b], lengths[a:b]), of["own"][tokens], of["free"][tokens]).astype(np.float64)
            within[(flags & RIGHT) > 0] = 0.0
            ends, syms = starts + lengths[a:b], syms16[tokens]
            out.append((
                np.add.reduceat(known[tokens].astype(np.int64), starts), np.add.reduceat(base[tokens], starts), np.add.reduceat(within, starts),
                [syms[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], [flags[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)],
            ))
            a = b
        cols = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.float64, np.float64))]
        cols += [pa.array([y for x in out for y in x[k]], pa.binary()) for k in (3, 4)]
        return pa.table([left["doc_id"], left["held_out"], left["n_tokens"], left["n_bytes"], *cols], ["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "within", "syms", "flags"])

    return docs.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(run, ddl)


def _streams(syms: list[bytes], flags: list[bytes], symbols: Symbols, bits: int, sizes: tuple[int, int, int] = STREAM_TOKENS) -> Iterator[tuple[Stream, list[int], np.ndarray]]:
    """Streams of some documents each, their places in the lists, and where they start."""
    some, size, read = [], 0, 0
    for k in range(len(syms) + 1):
        if some and (k == len(syms) or size >= _next(read, sizes)):
            s = [np.frombuffer(syms[i], np.uint16) for i in some]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in s])[:-1])).astype(np.int64)
            yield Stream(np.concatenate(s), np.frombuffer(b"".join([flags[i] for i in some]), np.uint8), starts, symbols, bits), some, starts
            some, size, read = [], 0, read + size
        if k < len(syms):
            some.append(k)
            size += len(flags[k])


def _count_contexts(known: DataFrame, symbols: Symbols, bits: int, n: int) -> list[np.ndarray]:
    """The states of the contexts' tables over all training documents."""
    lanes = _lanes(n)
    held = known.sparkSession.sparkContext.broadcast(symbols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((CONTEXTS, 1 << bits, 2), np.uint32)
        for batch in batches:
            for stream, _, _ in _streams(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held.value, bits):
                count_stream(stream, tables)
        yield from _pieces(tables.reshape(-1), lanes)

    flat = _sum_parts(known.select("syms", "flags").coalesce(_trainers(n)).mapInArrow(count, _TABLE), CONTEXTS << (bits + 1), lanes)
    return [pack_states(t) for t in flat.reshape(CONTEXTS, -1, 2)]


def _learn_mixer(known: DataFrame, held: Broadcast, bits: int, n: int) -> Mixer:
    """Learned online over all training documents, by shards that their hash deals, in the order of their hash."""
    shards, lanes = max(1, n // TRAINER_TOKENS, min(TRAINERS, n // SHARD_TOKENS)), _lanes(n)
    shape = GATES, STREAM_LEVELS, CONTEXTS + 1

    def learn(table: pa.Table) -> pa.Table:
        symbols, states = held.value
        table, mixer = table.sort_by([("h", "ascending"), ("syms", "ascending")]), Mixer(*shape)
        for stream, _, _ in _streams(table["syms"].to_pylist(), table["flags"].to_pylist(), symbols, bits, ONLINE_TOKENS):
            learn_stream(stream, states, mixer)
        shard = table["shard"][0].as_py()
        return pa.Table.from_batches([_sums_row(shard % lanes, shard, mixer.sums())])

    dealt = known.select("syms", "flags", F.xxhash64("doc_id", "syms").alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return Mixer.merged(_add_sums(dealt.groupBy("shard").applyInArrow(learn, _SUMS), lanes), *shape)


def score(docs: DataFrame, chunk_words: int = CHUNK_WORDS, own_symbols: int = OWN_SYMBOLS, shared_symbols: int = SHARED_SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of ``docs``.

    Learns from the documents outside the held-out fold and scores all.  A null
    text counts as empty: its one token is the end.  A null doc_id counts as an
    empty text for the fold; ids keep their type.  Rows repeated with one
    doc_id are learned and scored each; very long texts are chunks of their
    own.  Without training documents the two symbols left are the end and all
    words, and words are spelled with even chances; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    coded = materialise(encode(docs.select("doc_id", "text"), max(16, -(-size // PART_BYTES)), chunk_words), "lm-coded")
    own = coded.where("part IS NOT NULL").select("part", "chunk", "words", "counts", "nums")
    merged = materialise(own.groupBy("part").applyInArrow(_merge, _MERGED), "lm-words")
    sums = merged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = sums["n"], sums["v"]
    symbols = _choose_symbols(merged, n, own_symbols, shared_symbols)
    spelling, spelled = _learn_spelling(merged, symbols, n)
    priced = _price(merged, spelling, spelled)
    rows = coded.where("part IS NULL").select("chunk", "doc_id", "held_out", "n_tokens", "n_bytes", "nums")
    resolved = materialise(_resolve(rows, priced, n, v), "lm-symbols")
    for done in (coded, merged):  # nothing reads them any more
        drop_table(done)
    spelling.destroy()
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() - 4))
    known = resolved.where("NOT held_out")
    tables = spark.sparkContext.broadcast((symbols, _count_contexts(known, symbols, bits, n)))  # of bounded size
    model = spark.sparkContext.broadcast(_learn_mixer(known, tables, bits, n))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (symbols, states), mixer = tables.value, model.value
        costs = [mixer.costs(g) for g in range(GATES)]
        for batch in batches:
            out, syms, flags = batch.column(6).to_numpy().copy(), batch.column(7).to_pylist(), batch.column(8).to_pylist()
            learned = ~batch.column(1).to_numpy(zero_copy_only=False)
            for mask in (True, False):
                at = np.flatnonzero(learned == mask)
                for stream, some, starts in _streams([syms[k] for k in at.tolist()], [flags[k] for k in at.tolist()], symbols, bits):
                    out[at[some]] += np.add.reduceat(score_stream(stream, states, mixer, costs, mask), starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(out)], ["doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = resolved.mapInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_bytes bigint, n_known bigint, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
