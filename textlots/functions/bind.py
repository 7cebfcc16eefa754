"""Names for intermediate results, and long lists as single literals."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(values: Iterable[str]) -> Column:
    """A list of strings, folded to one array literal; keeps the tree of a query small."""
    return F.split(F.lit("\n".join(_flat(values))), "\n")


def table(pairs: Iterable[tuple[str, str]]) -> Column:
    """Pairs of strings, folded to one map literal."""
    lines = "\n".join("\t".join(_flat(pair)) for pair in pairs)
    return F.str_to_map(F.lit(lines), F.lit("\n"), F.lit("\t"))


def _flat(values: Iterable[str]) -> list[str]:
    flat = list(values)
    if any("\n" in value or "\t" in value for value in flat):
        raise ValueError("words and phrases may not hold line breaks or tabs")
    return flat
