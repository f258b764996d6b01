"""Text functions as column expressions: word counts, chunks, prefixes, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.when(collapsed(text) == "", F.array().cast("array<string>")).otherwise(F.split(collapsed(text), " "))


def word_count(text: Column) -> Column:
    """Words of a text, counted without being cut out."""
    return F.regexp_count(text, F.lit(r"\S+"))


def tokens_of(words: Column) -> Column:
    """1.3 tokens a word, rounded down (in whole numbers, so no float rounding)."""
    return F.floor(words * 13 / 10).cast("long")


def approx_tokens(text: Column) -> Column:
    return tokens_of(word_count(text))


def default_overlap(length: int) -> int:
    """A fifth of the chunk length, one word at least."""
    return max(1, round(0.2 * length))


def chunks(text: Column, length: int, overlap: int | None = None) -> Column:
    """Windows of ``length`` words with ``overlap`` words in common (a fifth by default); a text of at most
    ``length`` words stays as it is."""
    overlap = default_overlap(length) if overlap is None else overlap
    if not 0 <= overlap < length:
        raise ValueError("overlap must be below the chunk length")
    step = length - overlap

    def cut(w: Column) -> Column:
        n = F.ceil((F.size(w) - length) / step)
        return F.when(F.size(w) <= length, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.array_join(F.slice(w, i * step + 1, length), " ")))

    return F.element_at(F.transform(F.array(words(text)), cut), 1)


def age_prefix(age: Column, text: Column) -> Column:
    return F.concat(F.lit("Patient age: "), age.cast("string"), F.lit(" years\n \n Clinical Note:\n"), text)


def without_age_prefix(text: Column) -> Column:
    return F.ltrim(F.regexp_replace(text, r"(?i)^\s*Patient\s+age:\s*\d+\s*years\s*Clinical\s+Note:\s*", ""))
