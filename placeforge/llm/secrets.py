"""Secret scans: base patterns, and assignment-aware lexing.

The lexer reads source and configuration syntax in a text: ``name = value``,
``name: value``, ``"name": value``, ``name => value``, ``name(value, ...)`` and
``<name>value</name>``.  A value is a quoted literal (escapes and triple quotes
as well), a bare one, a name, a list of these in brackets, or a concatenation by
``+``; after a colon it may stand on the next, deeper line.  Any run of blanks
may stand around a separator and names may have any length.

Each assignment is a version of its name.  A name in a value stands for its last
version before, or, where there is none, for its first one after.  So literals
flow through names (constant propagation), and how sensitive a name is flows
back: in ``k = "abc..."; password = k`` the first literal is found.  A literal is
scored by the most sensitive name that it reaches and by its own form, parts of
a concatenation also by the whole; what reaches ``threshold`` is a secret of kind
``lexed``.  The work is linear in the text: what was read as a value is not read
again.

Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed patterns: letters in either case are ASCII letters only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_KINDS = ("assign", "access", "hex")
#: What an assign match must contain, lower-cased: a quick test.
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitive words of a target name and their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6,
    "authorization": 0.8, "bearer": 0.8, "key": 0.4, "api": 0.3, "private": 0.4, "access": 0.3, "client": 0.1,
    "signing": 0.4, "encryption": 0.4, "salt": 0.4, "dsn": 0.6, "webhook": 0.4, "session": 0.3,
}
#: Words that make a name harmless: it holds a count, a place or a description.
HARMLESS = {"length", "len", "count", "max", "min", "size", "type", "url", "path", "file", "field", "name", "label", "limit", "hint", "policy", "expiry", "ttl", "tokens"}
#: Values that stand for a secret but are none.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change_?me|example|placeholder|none|null|true|false|todo|your[_-].*|redacted)$")

#: A name and what follows it: a separator, or the bracket of a call.  Runs are read whole, so no text is tried twice.
_TARGET = re.compile(r"""(?<![\w$.-])([A-Za-z_$][\w$.\[\]-]*+)(?:["']?\]?[\x20\t]*+(:=|=>|=(?!=)|:(?!//|=))|(\())""", re.ASCII)
_ELEMENT = re.compile(r"""<([A-Za-z_][\w.-]*+)>([^<>\n]*+)</\1>""", re.ASCII)
_GAP, _COMMA = re.compile(r"\s*+"), re.compile(r"\s*+,\s*+")
_BLANKS = re.compile(r"[\x20\t]*+")
_NEXT_LINE = re.compile(r"[|>]?[+-]?[\x20\t]*+\r?\n([\x20\t]++)(?![\x20\t\r\n#-])")
_QUOTED = re.compile(r"""[rbfuRBFU]{0,2}("|')((?:\\.|(?!\1)[^\\\n])*+)\1""")
_TRIPLE = re.compile(r"""[rbfuRBFU]{0,2}(\"{3}|'{3})""")
_BARE = re.compile(r"""[^\s"',;(){}\[\]<>|+&]++""")
_BARE_IN_LIST = re.compile(r"""[^\s"',;(){}\[\]<>|+&=:]++""")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*", re.ASCII)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: What some sensitive word contains: texts without any of these have no sensitive name.
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "api", "private", "access", "signing", "encryption", "salt", "dsn", "webhook", "session")
THRESHOLD = 1.3


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], _KINDS.index(x[0])))


def name_score(name: str) -> float:
    """How sensitive a target name is: its words' weights, 0 if a word makes it harmless."""
    words = [w.lower() for w in _NAME_WORD.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in {*words, *pairs}))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: its entropy and its mix of characters."""
    if len(value) < 8 or PLACEHOLDER.match(value) or " " in value.strip():
        return 0.0
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts)))
    return min(1.0, entropy / 4.0) * (0.5 if classes == 1 else 0.85 if classes == 2 else 1.0)


class _Reader:
    """Values of a text, each place read once."""

    def __init__(self, text: str):
        self.text = text
        self.unclosed: dict[str, int] = {}  # from where on triple quotes do not close

    def atom(self, at: int, bare: re.Pattern) -> tuple[int, int, int, bool] | None:
        """(start, end, where reading goes on, whether it may be a name) of a literal or name."""
        text = self.text
        if m := _TRIPLE.match(text, at):
            if m.end() < self.unclosed.get(m[1], len(text) + 1):
                close = text.find(m[1], m.end())
                if close >= 0:
                    return m.end(), close, close + 3, False
                self.unclosed[m[1]] = m.end()
        if m := _QUOTED.match(text, at):
            return m.start(2), m.end(2), m.end(), False
        if m := bare.match(text, at):
            return m.start(), m.end(), m.end(), True
        return None

    def chain(self, at: int, bare: re.Pattern) -> tuple[list[tuple[int, int, bool]], int]:
        """Atoms that are joined by ``+``."""
        parts: list[tuple[int, int, bool]] = []
        end = at
        while found := self.atom(_BLANKS.match(self.text, at).end(), bare):
            parts.append((found[0], found[1], found[3]))
            end = found[2]
            at = _BLANKS.match(self.text, end).end()
            if not self.text.startswith("+", at):
                break
            at += 1
        return parts, end

    def values(self, at: int, call: bool, colon: bool) -> tuple[list[list[tuple[int, int, bool]]], int]:
        """The values from ``at`` on: one, or those of a list; and where reading goes on."""
        if colon and (m := _NEXT_LINE.match(self.text, _BLANKS.match(self.text, at).end())):
            parts, end = self.chain(m.end(), _BARE)
            # a deeper mapping is no value
            return ([parts], end) if parts and not self.text[: end + 1].endswith(":") and not self.text.startswith(":", end) and self.text[end - 1] != ":" else ([], at)
        at = _BLANKS.match(self.text, at).end()
        if not call and self.text[at : at + 1] not in ("[", "(", "{"):
            parts, end = self.chain(at, _BARE)
            return ([parts] if parts else []), end
        found, end = [], _GAP.match(self.text, at + (not call)).end()
        while True:
            parts, after = self.chain(end, _BARE_IN_LIST)
            if parts:
                found.append(parts)
                end = after
            if not (m := _COMMA.match(self.text, end)):
                return found, end
            end = m.end()


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of the literals that reach a sensitive name."""
    low = text.lower()
    if not any(x in low for x in _STEMS):
        return []
    reader, done = _Reader(text), 0
    names: list[str] = []  # by version
    held: list[list[list[tuple[int, int]]]] = []  # by version: literals of each of its values
    into: list[list[int]] = []  # by version: versions that it flows into
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    waiting: dict[str, list[int]] = {}  # names that are used before any version

    def version(name: str, values: list[list[tuple[int, int, bool]]]) -> None:
        k = len(names)
        names.append(name)
        into.append([])
        own = []
        for parts in values:
            literals = []
            for a, b, bare in parts:
                word = text[a:b] if bare and b - a <= 200 else ""
                if word and _NAME.fullmatch(word) and word != name:
                    if word in last:
                        into[last[word]].append(k)
                        continue
                    waiting.setdefault(word, []).append(k)
                    if len(parts) > 1:
                        continue
                if b > a:
                    literals.append((a, b))
            own.append(literals)
        held.append(own)
        if name not in first:
            first[name] = k
            into[k] += waiting.pop(name, [])
        last[name] = k

    for m in _TARGET.finditer(text):
        if m.start() < done:
            continue
        values, end = reader.values(m.end(), m[3] is not None, m[2] == ":")
        if values:
            version(m[1], values)
            done = max(done, end)
    for m in _ELEMENT.finditer(text):
        version(m[1], [[(m.start(2), m.end(2), False)]])
    # how sensitive a version is: its own name, or a version that it flows into
    from_: list[list[int]] = [[] for _ in names]
    for k, ends in enumerate(into):
        for e in ends:
            from_[e].append(k)
    scored: dict[int, tuple[float, str]] = {}
    own_score = {n: name_score(n) for n in set(names)}
    for k in sorted(range(len(names)), key=lambda k: -own_score[names[k]]):
        value = (own_score[names[k]], names[k])
        todo = [k] if value[0] else []
        while todo:
            x = todo.pop()
            if x not in scored:
                scored[x] = value
                todo += from_[x]
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for k, (named, name) in scored.items():
        for literals in held[k]:
            whole = literal_score("".join([text[a:b] for a, b in literals])) if len(literals) > 1 else 0.0
            for a, b in literals:
                form = max(whole, literal_score(text[a:b]))
                if form and named + form >= threshold and named + form > best.get((a, b), (0.0, ""))[0]:
                    best[a, b] = (named + form, name)
    return [(a, b, n, round(s, 4)) for (a, b), (s, n) in sorted(best.items())]


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str | None, float]]:
    """All spans (kind, start, end, name, score) by start, then kind: the base ones (score 1), then ``lexed``."""
    text = text or ""
    base = [(k, a, b, None, 1.0) for k, a, b in base_spans(text)]
    return sorted(base + [("lexed", a, b, n, s) for a, b, n, s in lexed_spans(text, threshold)], key=lambda x: (x[1], (*_KINDS, "lexed").index(x[0])))


def redact(text: str | None, spans: list[tuple[str, int, int, str | None, float]]) -> str | None:
    """The text with its spans, joined where they overlap, replaced by ``[SECRET]``."""
    if text is None or not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][1], spans[k][2]
        while k + 1 < len(spans) and spans[k + 1][1] <= end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], "[SECRET]"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def digest(spans: list) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
_DDL = "found array<struct<kind:string,start:int,end:int,name:string,score:double>>, redacted string, base_sha256 string"


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, with_text: bool = False) -> DataFrame:
    """doc_id, found (spans), redacted, base_sha256 for each row of ``docs`` (doc_id, text).

    ``redacted`` is null unless ``with_text`` is set.  A null text is scanned as
    empty (no spans) and stays null; very long texts take time in proportion; repeated rows each give a row; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, sums = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                spans = scan(text, threshold)
                found.append([dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in spans])
                texts.append(redact(text, spans) if with_text else None)
                sums.append(hashlib.sha256(digest([s for s in spans if s[0] != "lexed"]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(_SPAN)), pa.array(texts, pa.string()), pa.array(sums, pa.string())],
                ["doc_id", "found", "redacted", "base_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_DDL}")


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced; the other columns as they are.

    A null text stays null, an empty one empty; repeated rows are each cleaned;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([redact(x, scan(x, threshold)) for x in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(run, docs.schema)
