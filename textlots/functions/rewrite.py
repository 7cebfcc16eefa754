"""Dictionary rewrite: shorter English wording for known Spanish phrases and words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlots.functions.bind import bind, table, words
from textlots.functions.keywords import any_of, every_place
from textlots.functions.rules import any_hit
from textlots.functions.text import clean
from textlots.packs.dictionary import PHRASES, WORDS

# Fixed value: the letters a word may hold.
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
ACCENTED, PLAIN = "áéíóúüñ", "aeiouun"

# Characters that leave the quick way: letters that a case-blind match takes for s, i or k,
# and the mark that the quick way puts around words.
MARK = "\x01"
UNUSUAL = ("\u017f", "\u0131", "\u0130", "\u212a", MARK)

Pairs = Sequence[tuple[str, str]]


def by_length(phrases: Pairs) -> list[tuple[str, str]]:
    """Longest phrase first; equal lengths keep their order."""
    return sorted(phrases, key=lambda pair: -len(pair[0]))


def _steps(phrases: Pairs) -> tuple[Column, Callable[[Column, Column], Column]]:
    """The Spanish phrases, and the replacement of the i-th in a text, counted from 1."""
    spanish = words(phrase for phrase, _ in phrases)
    english = words(wording for _, wording in phrases)

    def apply(text: Column, i: Column) -> Column:
        # A quoted literal and a case-blind match; "$" and "\\" cannot occur in the wording.
        pattern = F.concat(F.lit(r"(?iu)\Q"), F.get(spanish, i - 1), F.lit(r"\E"))
        return F.regexp_replace(text, pattern, F.get(english, i - 1))

    return spanish, apply


def _in_turn(text: Column, phrases: Pairs) -> Column:
    """Every phrase in turn, present or not."""
    _, apply = _steps(phrases)
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(phrases))), text, apply)


def _present_only(text: Column, phrases: Pairs) -> Column:
    """The same result by applying only phrases that occur.

    After each replacement the text is searched again, since a new wording may complete a
    later phrase; the steps left over once nothing is found cost nothing.
    """
    place = every_place(phrase for phrase, _ in phrases)
    spanish, replace = _steps(phrases)

    def state(value: Column, following: Column, going: Column) -> Column:
        return F.struct(value.alias("text"), following.alias("following"), going.alias("going"))

    def next_phrase(current: Column) -> Column:
        """Position of the first phrase from ``following`` on that occurs."""

        def position(longest: Column) -> Column:
            # The longest phrase at a place stands for the shorter ones it begins with.
            hits = F.filter(
                F.sequence(current["following"], F.lit(len(phrases))),
                lambda i: F.exists(longest, lambda f: F.startswith(f, F.get(spanish, i - 1))),
            )
            return F.array_min(hits)

        def search(lowered: Column) -> Column:
            found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(place), F.lit(1)))
            left = current["following"] <= len(phrases)
            return F.when(left, bind(found, lambda longest: F.when(F.size(longest) > 0, position(longest))))

        return bind(F.lower(current["text"]), search)

    def step(current: Column, _: Column) -> Column:
        def apply(i: Column) -> Column:
            replaced = replace(current["text"], i)
            return F.when(
                i.isNull(), state(current["text"], current["following"], F.lit(False))
            ).otherwise(state(replaced, i + 1, F.lit(True)))

        return F.when(~current["going"], current).otherwise(bind(next_phrase(current), apply))

    steps = F.sequence(F.lit(1), F.lit(len(phrases) + 1))
    start = state(text, F.lit(1), F.lit(True))
    return F.aggregate(steps, start, step, lambda done: done["text"])


def unusual(text: Column) -> Column:
    return any_hit(text, UNUSUAL)


def replace_phrases(text: Column, phrases: Pairs = PHRASES) -> Column:
    """Replace every phrase, in any case, each on the result of the one before."""
    ordered = by_length(phrases)
    return F.when(unusual(text), _in_turn(text, ordered)).otherwise(_present_only(text, ordered))


def _swap(pairs: Pairs) -> Callable[[Column], Column]:
    """What becomes of one word (or of any other run of characters)."""
    # One small map per word length, so a lookup compares a handful of keys, not all.
    by_size: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for spanish, english in pairs:
        by_size[len(spanish)].append((spanish, english))
    longest = max(by_size)
    tables = F.array(*[table(by_size.get(size, [("", "")])) for size in range(1, longest + 1)])

    def swap(run: Column) -> Column:
        same_size = F.get(tables, F.length(run) - 1)
        key = F.lower(run)
        found = F.coalesce(
            F.element_at(same_size, key), F.element_at(same_size, F.translate(key, ACCENTED, PLAIN))
        )
        initial = F.substring(run, 1, 1)
        capital = F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 99))
        return (
            F.when((F.length(run) > longest) | found.isNull(), run)
            .when(run == F.upper(run), F.upper(found))
            .when(initial == F.upper(initial), capital)
            .otherwise(found)
        )

    return swap


def _letter(ch: str) -> str:
    """A plain letter in both cases, with and without its accents."""
    marked = "".join(a for a, p in zip(ACCENTED, PLAIN) if p == ch)
    return "".join(dict.fromkeys(f"{ch}{marked}{(ch + marked).upper()}"))


def _every_run(text: Column, swap: Callable[[Column], Column]) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))
    return F.array_join(F.transform(runs, swap), "")


def _known_only(text: Column, pairs: Pairs, swap: Callable[[Column], Column]) -> Column:
    """The same result by looking up only words that the dictionary may know.

    One pattern finds them, whatever their case and accents, and marks their ends.
    """
    unmark = str.maketrans(ACCENTED, PLAIN)
    plain = dict.fromkeys(spanish.translate(unmark) for spanish, _ in pairs)
    known = f"(?<![{LETTERS}]){any_of(plain, _letter)}(?![{LETTERS}])"
    pieces = F.split(F.regexp_replace(text, known, f"{MARK}$0{MARK}"), MARK)
    # Every odd place lies between two marks and is a word.
    swapped = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, swap(piece)).otherwise(piece))
    return F.array_join(swapped, "")


def replace_words(text: Column, pairs: Pairs = WORDS) -> Column:
    """Replace known words; ALL CAPS and Capitalised words keep their form."""
    swap = _swap(pairs)
    return F.when(unusual(text), _every_run(text, swap)).otherwise(_known_only(text, pairs, swap))


def dict_rewrite(text: Column, phrases: Pairs = PHRASES, pairs: Pairs = WORDS) -> Column:
    """Phrases, then words, then white space."""
    return clean(bind(replace_phrases(text, phrases), lambda phrased: replace_words(phrased, pairs)))
