"""The text contract as native column expressions.

Keys of gazetteers and of queries must come from the same functions; a change
of what ``normalize`` returns needs a new ``NORM_VERSION`` and a rebuild.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_VERSION = "1"

#: Words that qualify a place, in the order in which they are tried.
QUALIFIER_PREFIXES = ("GREATER", "METROPOLITAN", "METRO", "INNER", "OUTER", "CENTRAL", "CITY OF", "SHIRE OF", "MUNICIPALITY OF", "TOWN OF", "BOROUGH OF")
QUALIFIER_SUFFIXES = ("METROPOLITAN AREA", "METRO AREA", "AND SURROUNDS", "METROPOLITAN", "SURROUNDS", "DISTRICT", "REGION", "COUNTY", "METRO", "AREA", "CBD")

#: Letters that become several, and signs that have an ASCII look.
_SEVERAL = {"ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ĳ": "IJ", "ĳ": "ij", "…": "..."}
_SINGLE = {"Ø": "O", "ø": "o", "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l", "Ŋ": "N", "ŋ": "n", "Ŧ": "T", "ŧ": "t", "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "’": "'", "‘": "'", "“": '"', "”": '"', " ": " "}


@cache
def folding() -> tuple[str, str]:
    """Characters with one ASCII base letter, and those letters: by Unicode decomposition, Latin blocks only."""
    found = dict(_SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[:1]
        rest = unicodedata.normalize("NFKD", char)[1:]
        if char not in found and char not in _SEVERAL and base.isascii() and base.isalpha() and all(map(unicodedata.combining, rest)):
            found[char] = base
    return "".join(found), "".join(found.values())


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often the body uses it, in lambdas as well."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def transliterate(c: Column | str) -> Column:
    """ASCII look of Latin text; what has none becomes a space.  ASCII text is left as it is."""
    c = _text(c)
    folded = c
    for char, several in _SEVERAL.items():
        folded = F.replace(folded, F.lit(char), F.lit(several))
    folded = F.translate(F.regexp_replace(folded, "[̀-ͯ]", ""), *folding())
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]+", " ")
    return F.when(c.rlike(r"\A[\x00-\x7F]*\z"), c).otherwise(folded)


def normalize(c: Column | str) -> Column:
    """A stable comparison key: '' for null; ASCII, upper case, ``&`` spelled, one space between words."""
    s = F.upper(transliterate(F.coalesce(_text(c), F.lit(""))))
    s = F.replace(s, F.lit("&"), F.lit(" AND "))
    s = F.regexp_replace(s, r"[^A-Z0-9/\- ]+", " ")
    s = F.regexp_replace(s, r" *- *", "-")
    return F.trim(F.regexp_replace(s, r" +", " "))


def tokens(norm: Column | str) -> Column:
    """Words of a normalised text; none of the empty one."""
    n = _text(norm)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def strip_qualifiers(norm: Column | str) -> Column:
    """Takes qualifying words off both ends until none is left; never takes the last word.

    Prefixes in their order, then suffixes, then again: every pass that changes
    anything takes at least one word, so there are at most as many as words.
    """
    rules = F.array(*[F.struct(F.lit(p + " ").alias("text"), F.lit(True).alias("front")) for p in QUALIFIER_PREFIXES], *[F.struct(F.lit(" " + s).alias("text"), F.lit(False).alias("front")) for s in QUALIFIER_SUFFIXES])

    def apply(text: Column, rule: Column) -> Column:
        size, own = F.length(text), F.length(rule["text"])
        front = rule["front"] & F.startswith(text, rule["text"]) & (size > own)
        back = ~rule["front"] & F.endswith(text, rule["text"]) & (size > own)
        return F.when(front, F.substring(text, own + 1, size)).when(back, F.substring(text, F.lit(1), size - own)).otherwise(text)

    def passes(n: Column) -> Column:
        words = F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1
        return F.trim(F.aggregate(F.flatten(F.array_repeat(rules, words)), n, apply))

    return _once(_text(norm), passes)


def ngrams(toks: Column | str, max_len: int = 4) -> Column:
    """array<struct<start, end, span>>: all runs of up to ``max_len`` words, longest first, then from the left; ``end`` is exclusive."""

    def runs(t: Column) -> Column:
        n = F.size(t)

        def of_length(k: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), n - k),
                lambda s: F.struct(s.cast("int").alias("start"), (s + k).cast("int").alias("end"), F.array_join(F.slice(t, s + 1, k), " ").alias("span")),
            )

        found = F.flatten(F.transform(F.sequence(F.least(n, F.lit(max_len)), F.lit(1), F.lit(-1)), of_length))
        return F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,span:string>>"))

    return _once(_text(toks), runs)


def cache_key(prefix: str, raw: Column | str, *parts: Column) -> Column:
    """A key that changes with the text's normal form, the options and ``NORM_VERSION``."""
    payload = F.concat_ws("\x1f", normalize(raw), *parts)
    return F.concat(F.lit(f"{prefix}:{NORM_VERSION}:"), F.sha1(payload))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text (spaces only), null where nothing is left."""
    return F.nullif(F.trim(_text(c)), F.lit(""))


def at_least(got: Column, want: Column, order: tuple[str, ...]) -> Column:
    """Whether ``got`` is as specific as ``want`` or more, by an order from the most specific on."""
    ranks = F.array(*map(F.lit, order))
    return F.array_position(ranks, got) <= F.array_position(ranks, want)
