"""One pattern for many words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_GROUP = 5


def any_of(words: Iterable[str], shapes: Callable[[str], str] = lambda ch: ch) -> str:
    """Pattern that prefers the longest of the words at a place.

    ``shapes`` names all characters that count as a letter. Shared beginnings are written
    once, and wide branches are split by first letters, so that most places in a text are
    dismissed after a few comparisons.
    """
    by_first: dict[str, list[str]] = {}
    ends = False
    for word in words:
        if word:
            by_first.setdefault(word[0], []).append(word[1:])
        else:
            ends = True
    branches = [(first, _one(shapes(first)) + any_of(rest, shapes)) for first, rest in by_first.items()]
    if not branches:
        return ""
    if len(branches) == 1 and not ends:
        return branches[0][1]
    groups = [branches[i : i + _GROUP] for i in range(0, len(branches), _GROUP)]
    options = [
        f"(?={_one(''.join(shapes(first) for first, _ in group))})(?:{'|'.join(p for _, p in group)})"
        if len(groups) > 1
        else "|".join(p for _, p in group)
        for group in groups
    ]
    return f"(?:{'|'.join(options)})" + ("?" if ends else "")


def every_place(words: Iterable[str]) -> str:
    """Pattern that matches at every place where a word begins; its group is the longest word there.

    Two tests of single characters come first: most places are dismissed before the group is tried.
    """
    known = list(words)
    longest = f"(?=({any_of(known)}))"
    shortest = min(map(len, known), default=0)
    if not shortest:
        return longest
    first, *more = [_one("".join(dict.fromkeys(word[at] for word in known))) for at in range(min(shortest, 3))]
    ahead = f"(?={''.join(more)})" if more else ""
    return f"{first}{ahead}(?<={longest}{first})"


def _one(chars: str) -> str:
    return re.escape(chars) if len(chars) == 1 else f"[{re.escape(chars)}]"
