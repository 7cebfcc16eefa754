"""Compatibility decomposition without marks, over all of Unicode, as column expressions.

A character's decomposition does not depend on its neighbours, and once marks are left out
their order does not matter either, so characters can be replaced one by one. The tables
are computed from the character database that Python brings along:

* one character for one, and marks (none for one): a single ``translate``;
* several for one (ligatures, fractions, enclosed words): looked up per occurrence, and only
  in texts that hold such a character;
* Hangul syllables: letters by arithmetic on the code point.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlots.functions.bind import bind, words

# How Unicode lays out Hangul syllables and the letters they consist of.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADS, N_VOWELS, N_TAILS = 19, 21, 28
LAST_SYLLABLE = SYLLABLES + N_LEADS * N_VOWELS * N_TAILS - 1
SURROGATES = range(0xD800, 0xE000)


def plain(text: str) -> str:
    """A text decomposed and without its marks; what ``fold`` computes for columns."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters replaced by one each and those left out, what the first become, and longer replacements."""
    one, none, many = {}, [], {}
    for code in range(sys.maxunicode + 1):
        if code in SURROGATES or SYLLABLES <= code <= LAST_SYLLABLE:
            continue
        char = chr(code)
        folded = plain(char)
        if folded == char:
            continue
        if len(folded) == 1:
            one[char] = folded
        elif folded:
            many[char] = folded
        else:
            none.append(char)
    # translate() leaves out the characters that have no counterpart at the end.
    return "".join([*one, *none]), "".join(one.values()), many


def _ranges(codes: list[int], gap: int = 0) -> list[tuple[int, int]]:
    """First and last code of the runs whose members are at most ``gap`` further than neighbours."""
    starts = [c for i, c in enumerate(codes) if not i or c - codes[i - 1] > gap + 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] - c > gap + 1]
    return list(zip(starts, ends))


def _class(chars: str) -> str:
    """The inside of a character class. A character outside all regions takes one test per region."""

    def span(first: int, last: int) -> str:
        return f"\\x{{{first:x}}}-\\x{{{last:x}}}"

    codes = sorted(map(ord, chars))
    regions = []
    for low, high in _ranges(codes, gap=255):
        inside = "".join(span(*run) for run in _ranges([c for c in codes if low <= c <= high]))
        regions.append(f"[{span(low, high)}&&[{inside}]]")
    return "".join(regions)


def _letters(syllable: Column) -> Column:
    """The letters of a Hangul syllable."""
    place = F.ascii(syllable) - SYLLABLES

    def letter(base: int, n: int, at: Column, first: int = 0) -> Column:
        return F.get(words(chr(base + i) if i >= first else "" for i in range(n)), at.cast("int"))

    return F.concat(
        letter(LEADS, N_LEADS, F.floor(place / (N_VOWELS * N_TAILS))),
        letter(VOWELS, N_VOWELS, F.floor(place / N_TAILS) % N_VOWELS),
        letter(TAILS, N_TAILS, place % N_TAILS, first=1),
    )


def fold(c: Column) -> Column:
    """Compatibility decomposition of a text, without marks; null stays null."""
    singles, become, many = _tables()
    syllable = f"[\\x{{{SYLLABLES:x}}}-\\x{{{LAST_SYLLABLE:x}}}]"
    # Most letters are told apart by their first test.
    special = f"[\\x{{80}}-\\x{{10ffff}}&&[{syllable}{_class(''.join(many))}]]"
    other = f"[\\x00-\\x7f[^{syllable}{_class(''.join(many))}]]"
    keys, values = F.lit("".join(many)), words(many.values())

    def expanded(piece: Column) -> Column:
        # A piece is one special character, or a run without any: that is in no key.
        found = F.get(values, F.instr(keys, piece) - 1)
        return F.when(piece.rlike(f"^{syllable}"), _letters(piece)).otherwise(F.coalesce(found, piece))

    def whole(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"{special}|{other}+"), F.lit(0))
        return F.when(text.rlike(special), F.array_join(F.transform(pieces, expanded), "")).otherwise(text)

    return bind(F.translate(c, singles, become), whole)
