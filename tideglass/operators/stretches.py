"""Whole numbers in stretches: halved again and again, stretch ``at`` of level n holds the numbers from ``at`` times 2^n on, 2^n of them.

A range of numbers is made of at most two stretches of each level, and a number lies in one of each level. So "which ranges hold
this number" and "which numbers lie in this range" are joins on equal stretches, however long the ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stretch(level: Column, at: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), at.alias("at"))


def holding(at: Column, bits: int) -> Column:
    """The stretches of levels 0 to ``bits`` that hold a number: an array of ``(level, at)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda n: _stretch(n, F.call_function("shiftright", at, n)))


def covering(lo: Column, hi: Column, bits: int) -> Column:
    """The fewest stretches that make up the numbers from ``lo`` to ``hi``, none if there are no such numbers. Ranges of over 2^``bits`` numbers
    are made of many stretches of the last level."""
    levels = F.sequence(F.lit(0), F.lit(bits))
    first = lambda n: F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1, n)
    end = lambda n: F.call_function("shiftright", hi + 1, n)
    odd = lambda x: x.bitwiseAND(1) == 1
    left = F.transform(F.filter(levels, lambda n: (n < bits) & (first(n) < end(n)) & odd(first(n))), lambda n: _stretch(n, first(n)))
    right = F.transform(F.filter(levels, lambda n: (n < bits) & (first(n) < end(n)) & odd(end(n))), lambda n: _stretch(n, end(n) - 1))
    top = F.lit(bits)
    rest = F.when(first(top) < end(top), F.transform(F.sequence(first(top), end(top) - 1), lambda x: _stretch(F.lit(bits), x)))
    return F.concat(left, right, F.coalesce(rest, F.array().cast("array<struct<level:int,at:bigint>>")))
