"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf is a run of whole pre-tokens of about ``LEAF_CHARS`` characters with its
token count; inner nodes hold the sums of characters and tokens below.  Leaves
meet only where a space or line feed follows a character that is no white
space: there the pre-token pattern always ends a match, and nothing on one side
depends on the other, so the counts of leaves add up to the document's.

An edit is looked up by the character sums.  Only the leaves that it touches
are encoded again, with as many neighbours as it takes until both ends of the
region are such borders again; then the sums above them are renewed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 512
_BORDER = re.compile(r"(?<=\S)[ \n]")


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(ranks: dict[bytes, int]) -> Callable[[str], int]:
    import tiktoken

    coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coding.encode_ordinary(text))


def is_border(before: str, after: str) -> bool:
    """Whether the pre-tokens of two texts that meet are those of each alone."""
    return not before or not after or (after[0] in " \n" and not before[-1].isspace())


def runs(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text cut at the first border after each ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size and (m := _BORDER.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if text[at:] else out


class SegmentTree:
    """Sums of characters and tokens over leaves; leaf k is node ``size + k``."""

    def __init__(self, leaves: list[str], counts: list[int], count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars = count, leaf_chars
        self._build(leaves, counts)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS) -> SegmentTree:
        leaves = runs(text, leaf_chars)
        return cls(leaves, [count(x) for x in leaves], count, leaf_chars)

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.size - len(leaves))
        self.tokens = [0] * self.size + counts + [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        for k in range(self.size - 1, 0, -1):
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the end: the last one), and where the leaf starts."""
        k, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def edit(self, start: int, end: int, text: str) -> int:
        """Replaces characters start to end; returns how many characters were encoded again."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError("edit outside the text")
        if start == end and not text:
            return 0
        if not self.chars[1]:
            leaves = runs(text, self.leaf_chars)
            self._build(leaves, [self.count(x) for x in leaves])
            return len(text)
        a, begin = self.find(start)
        b, _ = self.find(end)
        new = "".join(self.leaves[a : b + 1])
        new = new[: start - begin] + text + new[end - begin :]
        while (left := self._beside(a, -1)) is not None and not (new and is_border(self.leaves[left], new)):
            new, a = self.leaves[left] + new, left
        while (right := self._beside(b, 1)) is not None and not (new and is_border(new, self.leaves[right])):
            new, b = new + self.leaves[right], right
        parts = runs(new, self.leaf_chars)
        counts = [self.count(x) for x in parts]
        room = b - a + 1
        if len(parts) > 2 * room:  # much longer than before: a new tree, from the leaves' known counts
            leaves = [*self.leaves[:a], *parts, *self.leaves[b + 1 :]]
            known = [*self.tokens[self.size : self.size + a], *counts, *self.tokens[self.size + b + 1 :]]
            held = [(x, c) for x, c in zip(leaves, known, strict=True) if x]
            self._build([x for x, _ in held], [c for _, c in held])
            return len(new)
        if len(parts) > room:
            parts[room - 1 :], counts[room - 1 :] = ["".join(parts[room - 1 :])], [sum(counts[room - 1 :])]
        for k in range(room):
            self.leaves[a + k] = parts[k] if k < len(parts) else ""
            self.tokens[self.size + a + k] = counts[k] if k < len(parts) else 0
            self.chars[self.size + a + k] = len(self.leaves[a + k])
        low, high = (self.size + a) // 2, (self.size + b) // 2
        while low:
            for k in range(low, high + 1):
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            low, high = low // 2, high // 2
        return len(new)

    def _beside(self, k: int, step: int) -> int | None:
        """The next leaf that holds text, if any."""
        k += step
        while 0 <= k < self.size:
            if self.leaves[k]:
                return k
            k += step
        return None


Edits = list[tuple[int, int, str]]


def apply_edits(tree: SegmentTree, edits: Edits) -> int:
    """Edits of the text as it was, apart from each other; returns the characters encoded again."""
    return sum(tree.edit(*e) for e in sorted(edits, reverse=True))


#: What the default edits replace.
_PERSONAL = re.compile(r"(?P<url>https?://[^\s|]+)|(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<number>\+?\d[\d -]{6,}\d)", re.ASCII)


def personal_edits(text: str) -> Edits:
    """Each web address, e-mail address and long number becomes its kind's name."""
    if not any(x in text for x in ("://", "@")) and not any(c in text for c in "0123456789"):
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in _PERSONAL.finditer(text)]


_TREE = "leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint"


def _named(docs: DataFrame, *more: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(more)


def build_trees(docs: DataFrame, path: str = RANKS_PATH, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens, n_tokens: the leaves from which a tree is made again without encoding."""
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(held.value)
        for batch in batches:
            chars, tokens = [], []
            for x in batch.column(1):
                leaves = runs(x.as_py() or "", leaf_chars)
                chars.append([len(y) for y in leaves])
                tokens.append([count(y) for y in leaves])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(list(map(sum, tokens)), pa.int64())],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _named(docs, "text string", _TREE))


def recount(trees: DataFrame, edits: str | Callable[[str], Edits] = personal_edits, path: str = RANKS_PATH, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Applies edits to the documents of ``build_trees`` and gives the new text, leaves and counts.

    edits: a column of ``trees`` with array<struct<start,end,text>>, or a
    function of the text.  Edits must not overlap.  Returns doc_id, text,
    leaf_chars, leaf_tokens, n_tokens, tokens_before, n_edits, encoded_chars.
    A null text counts as empty and stays null where nothing is inserted;
    repeated rows each give a row; other columns are ignored.
    """
    held = trees.sparkSession.sparkContext.broadcast(load_ranks(path))
    column = edits if isinstance(edits, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(held.value)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, at, leaves = row["text"] or "", 0, []
                for n in row["leaf_chars"]:
                    leaves.append(text[at : at + n])
                    at += n
                tree = SegmentTree(leaves, row["leaf_tokens"], count, leaf_chars)
                own = [(e["start"], e["end"], e["text"]) for e in row["edits"] or ()] if column else edits(text)
                again = apply_edits(tree, own)
                kept = [(len(x), c) for x, c in zip(tree.leaves, tree.tokens[tree.size :], strict=True) if x]
                rows.append((
                    tree.text if tree.text or row["text"] is not None else None, [n for n, _ in kept], [c for _, c in kept],
                    tree.total, row["n_tokens"], len(own), again,
                ))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "tokens_before", "n_edits", "encoded_chars"],
            )

    given = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", *([trees[column].alias("edits")] if column else []))
    return given.mapInArrow(run, _named(trees, "text string", _TREE, "tokens_before bigint, n_edits bigint, encoded_chars bigint"))
