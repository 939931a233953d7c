"""Column helpers for the operators that use only built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that part words, as a set for trim() and as a pattern.
SPACES, SPACE_RUN = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body, or a lambda in it, uses it."""
    return F.transform(F.array(value), body)[0]


def space_words(text: Column) -> Column:
    """Words of a text between white space; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def sums_before(lengths: Column, block: int = 64) -> Column:
    """For each place of an array of numbers the sum of those before it; block sums keep long arrays cheap.

    The array is computed once, then each number adds half a block and each block the blocks before it.
    """
    none = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, none, lambda s, x: s + x)

    def summed(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda b: total(F.slice(all_, b * block + 1, block)))
        before = lambda sums: F.transform(sums, lambda _, b: F.when(b == 0, none).otherwise(total(F.slice(sums, F.lit(1), b))))
        start = lambda k: F.floor(k / block).cast("int")
        return let(let(blocks, before), lambda base: F.transform(all_, lambda _, k: base[start(k)] + total(F.slice(all_, start(k) * block + 1, k % block))))

    return let(lengths, lambda all_: F.when(F.size(all_) == 0, F.array().cast("array<bigint>")).otherwise(summed(all_)))
