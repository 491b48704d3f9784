"""Composite scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the semantic, length and word-count similarities, and of the file name.
SEMANTIC, LENGTH, WORDS = 0.7, 0.15, 0.15
CONTENT, FILENAME = 0.9, 0.1
# The same weights of content and file name in tenths, for whole numbers.
CONTENT_TENTHS, FILENAME_TENTHS = 9, 1


def composite(semantic: Column, length: Column, word: Column) -> Column:
    return SEMANTIC * semantic + LENGTH * length + WORDS * word


def blend(content: Column, filename: Column) -> Column:
    return CONTENT * content + FILENAME * filename


def units(score: Column, digits: int) -> Column:
    """A score of that many digits as a whole number of its last digit, so that sums are exact in any order."""
    return F.rint(score * F.lit(10.0**digits)).cast("long")


def from_units(value: Column, digits: int) -> Column:
    return value / F.lit(10.0**digits)


def divided(a: Column, b: Column) -> Column:
    """a by b (over 0) as the nearest whole number, halves away from zero."""
    near = F.call_function("div", F.lit(2) * F.abs(a) + b, F.lit(2) * b)
    return F.when(a < 0, -near).otherwise(near)


def blend_units(content: Column, shared: Column, total: Column, digits: int) -> Column:
    """Content (in units) blended with a file-name similarity of shared / total words, in units: no rounding but the last."""
    return divided(CONTENT_TENTHS * content * total + shared * F.lit(FILENAME_TENTHS * 10**digits), F.lit(CONTENT_TENTHS + FILENAME_TENTHS) * total)
