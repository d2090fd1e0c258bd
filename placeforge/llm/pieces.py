"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked (``▁`` for each space and one in front) and cut into marked
words, which no piece crosses.  The distinct words of a batch are sorted, so
that walking them in order walks their trie depth-first: the forward column of
a common prefix is computed once and stays on a stack.

For a unigram model the column of a prefix holds its best score and last piece.
For a BPE model it holds the last piece of the prefix's own encoding, of which
there is exactly one: a piece may follow the last piece of the rest if no merge
across their border comes before the merges that make the two.  Summed scores
would not give the merges' result there.  Characters without a piece become
their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts are taken together up to so many characters; words of a generation and pairs of pieces kept per worker.
_BLOCK_CHARS, _KEEP_WORDS, _KEEP_PAIRS = 4_000_000, 250_000, 300_000
_NEVER = float("inf")


@dataclass
class Lexicon:
    """Pieces with ids and scores.  kind: "bpe" or "unigram"."""

    pieces: list[str]
    scores: list[float]
    #: ids that text can match, and the ids of the 256 byte pieces
    plain: list[int]
    byte_ids: list[int]
    kind: str = "bpe"
    _memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str = MODEL_PATH, kind: str = "bpe") -> Lexicon:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        return cls(
            [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)],
            [i for i in range(n) if i not in special], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], kind,
        )

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("pieces", "scores", "plain", "byte_ids", "kind")} | {"_memo": {}}

    @cached_property
    def ids(self) -> dict[str, int]:
        found = {self.pieces[i]: i for i in self.plain}
        if crossing := [p for p in found if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        return found

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        found = [p.encode() for p in self.pieces]
        plain = set(self.plain)
        at = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return [at.get(i, x if i in plain else b"") for i, x in enumerate(found)]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    # -- BPE ----------------------------------------------------------------

    def merges(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of ``word`` by merging step by step, best score first, then leftmost; the last merge's parts."""
        ids, scores = self.ids, self.scores
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := ids.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, len(both)))

        for i in range(n - 1):
            offer(i)
        last = None
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            last = (parts[i], parts[j])
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None], last

    @cached_property
    def splits(self) -> dict[str, tuple[str, str] | None]:
        """The last merge of each piece that merging can make; None for single characters."""
        found: dict[str, tuple[str, str] | None] = {}
        for p in self.ids:
            made, last = self.merges(p)
            if made == [p]:
                found[p] = last
        return found

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """(part, when it is merged on) of the parts at one end of a piece; ``when`` is minus the score."""
        out, when = [], _NEVER
        while True:
            out.append((piece, when))
            if (split := self.splits[piece]) is None:
                return out
            when, piece = -self.scores[self.ids[piece]], split[side]

    def _made(self, piece: str) -> float:
        return -_NEVER if self.splits[piece] is None else -self.scores[self.ids[piece]]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends in these two pieces."""
        ids, scores = self.ids, self.scores
        for a, a_end in self._spine(left, 1):
            a_start = self._made(a)
            for b, b_end in self._spine(right, 0):
                if a_start >= b_end or self._made(b) >= a_end:
                    continue  # never there together
                k = ids.get(a + b)
                if k is not None and -scores[k] < a_end and -scores[k] <= b_end:
                    return False
        return True

    # -- forward columns ------------------------------------------------------

    @cached_property
    def reached(self) -> dict[str, int]:
        """Ids of the pieces that merging can make."""
        return {p: self.ids[p] for p in self.splits}

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, as packed 32-bit numbers; ``words`` may hold repeats."""
        out: dict[str, bytes] = {}
        ids, sizes, bpe = self.ids, self.sizes, self.kind == "bpe"
        advance = self._advance_bpe if bpe else self._advance_unigram
        longest = max(map(len, words), default=0)
        # columns by prefix length: id of the last piece (-1 at the start, and for bytes), score
        last, score = [-1] * (longest + 1), [0.0] * (longest + 1)
        before = ""
        for word in sorted(set(words)):
            if bpe and word.startswith(MARK * 2):
                # runs of marks have pieces of one score: their merges are done as such
                out[word] = array("i", [i for p in self.merges(word)[0] for i in ([ids[p]] if p in ids else self.fallback(p))]).tobytes()
                continue
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            advance(word, shared + 1, last, score)
            before = word
            found: list[int] = []
            at = len(word)
            while at:
                k = last[at]
                if k < 0:
                    at -= 1
                    found += reversed(self.fallback(word[at]))
                else:
                    found.append(k)
                    at -= sizes[k]
            found.reverse()
            out[word] = array("i", found).tobytes()
        return out

    @cached_property
    def sizes(self) -> list[int]:
        return list(map(len, self.pieces))

    def _advance_bpe(self, word: str, first: int, last: list[int], score: list[float]) -> None:
        """Fills the columns of the prefixes of ``word`` from length ``first`` on."""
        reached, memo, longest = self.reached, self._memo, self.longest
        for end in range(first, len(word) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                k = reached.get(word[begin:end])
                if k is not None:
                    # at the word's start, and next to bytes, nothing merges with it
                    if (held := last[begin]) < 0:
                        last[end] = k
                        break
                    key = held << 32 | k
                    ok = memo.get(key)
                    if ok is None:
                        if len(memo) > _KEEP_PAIRS:
                            memo.clear()
                        ok = memo[key] = self.follows(self.pieces[held], self.pieces[k])
                    if ok:
                        last[end] = k
                        break
            else:
                last[end] = -1

    def _advance_unigram(self, word: str, first: int, last: list[int], score: list[float]) -> None:
        worst = min(self.scores, default=0.0) - 10.0
        for end in range(first, len(word) + 1):
            best = None
            for begin in range(max(0, end - self.longest), end):
                k = self.ids.get(word[begin:end])
                if k is not None and (best is None or score[begin] + self.scores[k] > best[1]):
                    best = (k, score[begin] + self.scores[k])
            if word[end - 1] not in self.ids and (best is None or score[end - 1] + worst > best[1]):
                best = (-1, score[end - 1] + worst)
            last[end], score[end] = best

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def marked(text: str) -> list[str]:
    """Marked words of a text; none of an empty one."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class _Encoder:
    """Encodes blocks of texts; keeps the ids of words seen lately, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        #: words of this and of the former generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lists(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        young, old = self.young, self.old
        if len(young) > _KEEP_WORDS:
            self.old = old = young
            self.young = young = {}
        fresh = []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    fresh.append(w)
        young |= self.lexicon.encode_words(fresh)
        return [young[w] for w in words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offset of each text's."""
        gc.disable()  # much is kept and nothing is cyclic: walks over it would find no garbage
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = _split(texts)
        coded = words.flatten().dictionary_encode()
        held = self.lists([MARK + w for w in coded.dictionary.to_pylist()])
        flat = np.frombuffer(b"".join(held), np.int32) if held else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) // 4)))
        at = coded.indices.to_numpy()
        sizes = ends[at + 1] - ends[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = flat[np.repeat(ends[at] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = words.offsets.to_numpy()
        return ids, total[offsets - offsets[0]]


def _split(texts: list[str | None]) -> pa.ListArray:
    """The marked words of each text, each without its first mark."""
    plain = [bool(x) and "  " not in x and MARK not in x and x[0] != " " for x in texts]
    # one space between words: what stands between spaces
    easy = pc.split_pattern(pa.array([x for x, p in zip(texts, plain, strict=True) if p], pa.string()), " ")
    if all(plain):
        return easy
    rest = pa.array([[w[1:] for w in marked(x or "")] for x, p in zip(texts, plain, strict=True) if not p], pa.list_(pa.string()))
    mask = np.array(plain)
    place = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
    return pa.concat_arrays([easy.cast(rest.type), rest]).take(pa.array(place))


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= _BLOCK_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict[int, _Encoder] = {}


def encode(docs: DataFrame, path: str = MODEL_PATH, kind: str = "bpe", round_trip: bool = True) -> DataFrame:
    """doc_id, ids (array of int), n_pieces, round_trip for each row of ``docs`` (doc_id, text).

    A null text has null ids, an empty one none; both count as exact round
    trips.  A text that holds the mark itself decodes with a space there, which
    is how the library decodes it as well, so ``round_trip`` is false.
    Repeated rows each give a row; other columns are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Lexicon.load(path, kind))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        encoder = _ENCODERS.get(id(lexicon))
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[id(lexicon)] = _Encoder(lexicon)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                ids, ends = encoder.encode(texts[a:b])
                nulls = np.array([x is None for x in texts[a:b]])
                exact = [
                    not round_trip or not x or lexicon.decode(ids[s:e].tolist()) == x
                    for x, s, e in zip(texts[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                ]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(nulls, False)), pa.array(ids, pa.int32()))
                counts = pa.array(np.diff(ends), mask=nulls)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lists, counts, pa.array(exact)], ["doc_id", "ids", "n_pieces", "round_trip"]
                )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, ids array<int>, n_pieces bigint, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Lexicon.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else held.value.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    doc_id = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_id}, text string")
