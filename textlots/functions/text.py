"""Text clean-up, predicates and small reshaping of one string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlots.functions.bind import bind
from textlots.functions.folding import fold

# What counts as white space: every character str.isspace() accepts. With (?U), \s is
# Unicode's white space; the four separator controls are missing from it.
UNICODE = "(?U)"
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"

# Function words that keep a word list from looking like a header.
STOPWORDS = (
    "de", "la", "el", "los", "las", "un", "una", "unos", "unas", "y", "o", "a",
    "al", "del", "con", "por", "para", "en", "que", "mi", "tu", "su", "no", "se",
)

MIN_CHARS = 10

# Runs that are more, or other, than one plain space.
RUN = f"{WS}(?:(?<! ){WS}*+|{WS}++)"

# A number of word-like pieces, each with the white space behind it: an estimate of its tokens.
PIECE = r"(?:\p{L}++|\p{N}{1,3}+|[^\s\p{L}\p{N}]++)\s*+"
PIECE_SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    stripped = F.regexp_replace(c, f"{UNICODE}^{WS}+|{WS}+$", "")
    return F.when(ends.rlike(f"{UNICODE}{WS}"), stripped).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{UNICODE}{WS}+$", "")


def clean(c: Column) -> Column:
    """Collapse runs of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(c.cast("string"), f"{UNICODE}{RUN}", " "))


def normalize(c: Column) -> Column:
    """Lower case, decomposed, without marks, stripped ends: for headers and lookups."""
    return bind(F.lower(fold(c)), strip)


def dedup_key(c: Column) -> Column:
    """16 bytes that are equal for texts equal up to case and outer white space.

    Never null, so that joins on it put no filter of their own below the shuffle.
    """
    return F.coalesce(F.unhex(F.md5(F.lower(strip(c)))), F.lit(b""))


def header_like(c: Column) -> Column:
    """Two or more short words, no punctuation and no function word."""
    words = "|".join(STOPWORDS)
    return (
        ~c.rlike("[,.;:!?]")
        & c.rlike(f"{UNICODE}{NOT_WS}{WS}+{NOT_WS}")
        & ~c.rlike(f"{UNICODE}{NOT_WS}{{13}}")
        & ~F.lower(c).rlike(f"{UNICODE}(?:^|{WS})(?:{words})(?:{WS}|$)")
    )


def junk_reason(c: Column) -> Column:
    """Why a cleaned cell is not usable text; null when it is usable."""
    return (
        F.when(c.isNull(), "no_value")
        .when(F.length(c) < 3, "under_3_chars")
        .when(~c.rlike(r"\p{L}"), "no_letter")
        .when(F.length(c) < MIN_CHARS, "under_10_chars")
        .when(header_like(c), "header_like")
    )


def compress(c: Column, max_chars: int = 280) -> Column:
    """Cut to ``max_chars``, at the last full stop if that is past the middle."""
    text = clean(c)
    cut = F.substring(text, 1, max_chars)
    after_dot = F.locate(".", F.reverse(cut))  # 1 when the cut ends with a dot
    kept = max_chars - after_dot + 1
    return (
        F.when(F.length(text) <= max_chars, text)
        .when((after_dot > 0) & (kept - 1 > max_chars // 2), F.substring(cut, F.lit(1), kept))
        .otherwise(F.concat(rstrip(cut), F.lit("…")))
    )


def summary(c: Column) -> Column:
    """First sentence of a report, at most 100 characters.

    The separators are tried in turn; a piece of 12 or more characters ends the search.
    """
    text = strip(c)
    pieces = [
        F.when(F.contains(text, F.lit(sep)), strip(F.substring_index(text, sep, 1)))
        for sep in (". ", "。", "\n")
    ]
    first, second, third = pieces
    piece = F.coalesce(
        F.when(F.length(first) >= 12, first),
        F.when(F.length(second) >= 12, second),
        third,
        second,
        first,
        text,
    )
    return shorten(piece)


def summary_compact(c: Column) -> Column:
    """Variant that only looks for ``". "`` beyond the twelfth character."""
    text = strip(c)
    piece = F.when(F.locate(". ", text) > 13, strip(F.substring_index(text, ". ", 1))).otherwise(text)
    return shorten(piece)


def shorten(c: Column, max_chars: int = 100) -> Column:
    cut = rstrip(F.substring(c, 1, max_chars - 3))
    return F.when(F.length(c) > max_chars, F.concat(cut, F.lit("…"))).otherwise(c)


def html_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def piece_count(c: Column) -> Column:
    """Estimated token count without a tokenizer; 0 for empty or null.

    Every piece becomes one character and no list of them is made; only white space at the start is left over.
    """
    marked = F.ltrim(F.regexp_replace(c, PIECE, "x"), F.lit(PIECE_SPACE))
    return F.coalesce(F.length(marked), F.lit(0)).cast("bigint")


# Patterns of an amount and of a date in a contract clause.
AMOUNT = (
    r"(?iu)(?:\$|USD|COP|EUR|MXN)?\s*(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?)"
    r"\s*(?:pesos|dolares|dólares|usd|eur)?"
)
DATE = (
    r"(?iu)(?<![\p{L}\p{N}_])(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"
    r"|\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4})(?![\p{L}\p{N}_])"
)


def amount_hint(c: Column) -> Column:
    """First money-like number as written, null if there is none."""
    return F.nullif(strip(F.regexp_extract(c, AMOUNT, 0)), F.lit(""))


def date_hint(c: Column) -> Column:
    """First date-like text, null if there is none."""
    return F.nullif(F.regexp_extract(c, DATE, 1), F.lit(""))
