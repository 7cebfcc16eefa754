"""Money and percentages on doubles, rounded the way the figures are published."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlots.functions.bind import bind


def round_even(x: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to the even digit.

    ``F.round`` rounds the printed form half up, which differs in the last digit
    for values such as 2.675 or 0.125. Splitting x in two halves of 26 bits makes
    both products with 10**digits exact, so the tie is seen exactly.
    """
    scale = F.lit(float(10**digits))

    def halves(v: Column) -> Column:
        big = v * F.lit(134217729.0)
        high = big - (big - v)
        return F.struct((high * scale).alias("a"), ((v - high) * scale).alias("b"))

    def parts(p: Column) -> Column:
        whole = F.floor(p["a"] + p["b"]).cast("double")
        return F.struct(whole.alias("whole"), ((p["a"] - whole) + p["b"]).alias("rest"))

    def result(r: Column) -> Column:
        odd = F.pmod(r["whole"], F.lit(2.0)) == 1.0
        up = (r["rest"] > 0.5) | ((r["rest"] == 0.5) & odd)
        return (r["whole"] + F.when(up, 1.0).otherwise(0.0)) / scale

    return bind(bind(bind(x, halves), parts), result)


def cost_usd(tokens: Column, price_per_million: Column) -> Column:
    return round_even(tokens.cast("double") / 1e6 * price_per_million, 6)


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1).cast("bigint"))


def share_pct(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / max(whole, 1), rounded."""
    return round_even(part.cast("double") / at_least_one(whole).cast("double") * 100.0, digits)


def truncate(x: Column) -> Column:
    """Drop the fraction, towards zero."""
    return x.cast("bigint")
