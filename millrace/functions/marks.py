"""Marks: sets of words (64-bit hashes) as a few hundred bits, by which pairs of sets are pruned without loss before words are fetched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shift(parts: int) -> int:
    return parts.bit_length() - 1


def word_marks(words: Column, parts: int = 8) -> Column:
    """``parts`` numbers (a power of two) of 64 bits, of which each word sets one bit."""
    one = F.lit(1).cast("long")

    def part(k: Column) -> Column:
        of_part = F.filter(words, lambda w: w.bitwiseAND(parts - 1) == k)
        return F.aggregate(of_part, F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", one, F.shiftrightunsigned(w, _shift(parts)).bitwiseAND(63).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), part)


def marked(marks: Column, word: Column, parts: int = 8) -> Column:
    """Whether a word may be among those of the marks; never false for one that is."""
    bits = F.get(marks, word.bitwiseAND(parts - 1).cast("int"))
    return F.call_function("shiftrightunsigned", bits, F.shiftrightunsigned(word, _shift(parts)).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def differing(a: Column, b: Column) -> Column:
    """In how many bits two marks differ: at most as many as there are words in one set only."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def may_hold(small: Column, large: Column) -> Column:
    """Whether all words of one set may be in the other; never false if they are."""
    return F.forall(F.zip_with(small, large, lambda x, y: x.bitwiseAND(F.bitwise_not(y))), lambda z: z == 0)
