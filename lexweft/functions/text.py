"""Text statistics and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space splits words.
WORD = r"(?U)\S+"
# What embedding models of this family expect in front of a text, and the bytes they are sent.
PROMPTS = {"document": "search_document: ", "query": "search_query: "}
PROMPT_BYTES = 4000


def char_length(text: Column) -> Column:
    return F.char_length(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """The set of words, case-sensitive."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """Smaller by larger count; 1 if both are 0, 0 if one is."""
    return F.when(F.greatest(a, b) == 0, 1.0).when(F.least(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def length_similarity(a: Column, b: Column) -> Column:
    return ratio(char_length(a), char_length(b))


def word_similarity(a: Column, b: Column) -> Column:
    return ratio(word_count(a), word_count(b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Intersection by union of two arrays of distinct values; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def word_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(words(a), words(b))


def leading_text(pos: Column, text: Column, n: int = 30) -> Column:
    """Aggregate: the texts of a document's first ``n`` rows in order, joined by blanks."""
    first = F.array_sort(F.collect_list(F.when(pos < n, F.struct(pos.alias("pos"), text.alias("text")))))
    return F.array_join(F.transform(first, lambda x: x["text"]), " ")


def normalize_filename(name: Column) -> Column:
    return F.translate(name, "-_", "  ")


def filename_words(name: Column) -> Column:
    """The set of words of a file name, with - and _ as blanks."""
    return words(normalize_filename(name))


def filename_similarity(a: Column, b: Column) -> Column:
    """Word-set Jaccard of file names with - and _ as blanks."""
    return word_jaccard(normalize_filename(a), normalize_filename(b))


def prompt(text: Column, role: str) -> Column:
    """The text as sent to an embedding model: prefixed, cut to PROMPT_BYTES at a character boundary."""
    full = F.concat(F.lit(PROMPTS[role]), text)
    raw = full.cast("binary")
    inner = lambda at: F.hex(F.substring(raw, at, 1)).rlike("^[89AB]")  # noqa: E731 - a byte within a character
    end = F.when(~inner(PROMPT_BYTES + 1), PROMPT_BYTES).when(~inner(PROMPT_BYTES), PROMPT_BYTES - 1).when(~inner(PROMPT_BYTES - 1), PROMPT_BYTES - 2).otherwise(PROMPT_BYTES - 3)
    return F.when(F.octet_length(full) > PROMPT_BYTES, F.substring(raw, F.lit(1), end).cast("string")).otherwise(full)
