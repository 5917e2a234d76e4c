"""Text statistics as Spark columns, for quality operators. Null texts count as empty; whole texts are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.llm import common as C


def words_of(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    return F.array_remove(F.split(text, C.SPACE_RUN), "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1.0))


def counts(text: Column) -> dict[str, Column]:
    """Raw counts, each read from the text once; shares() turns them into statistics."""
    words = words_of(text)
    lines = F.split(text, "\n")
    return {
        "_chars": F.length(text).cast("double"),
        "_words": F.size(words).cast("double"),
        "_distinct": F.size(F.array_distinct(words)).cast("double"),
        "_spaces": matches(text, "[\\x20\\x09-\\x0D]"),
        "_symbols": matches(text, "[#*$%&<>@^~=+{}\\[\\]\\\\]"),
        "_pipes": matches(text, "[|]"),
        "_marks": matches(text, "[!?]"),
        "_stops": matches(text, "[.,;:]"),
        "_upper": matches(text, "\\p{Lu}"),
        "_digits": matches(text, "[0-9]"),
        "_lines": F.size(lines).cast("double"),
        "_distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
    }


def shares() -> dict[str, Column]:
    c = F.col
    solid = c("_chars") - c("_spaces")
    return {
        "n_words": c("_words"),
        "word_length": share(solid, c("_words")),
        "distinct_words": share(c("_distinct"), c("_words")),
        "repetition": share(c("_words"), c("_distinct")),
        "symbols": share(c("_symbols"), solid),
        "pipes": share(c("_pipes"), c("_words")),
        "marks": share(c("_marks"), c("_words")),
        "stops": share(c("_stops"), c("_words")),
        "upper": share(c("_upper"), solid),
        "digits": share(c("_digits"), solid),
        "line_words": share(c("_words"), c("_lines")),
        "repeated_lines": 1 - share(c("_distinct_lines"), c("_lines")),
    }


NAMES = ["n_words", "word_length", "distinct_words", "repetition", "symbols", "pipes", "marks", "stops", "upper", "digits", "line_words", "repeated_lines"]


def with_statistics(rows, text_col: str):
    """rows without the text, with the statistics of NAMES."""
    others = [c for c in rows.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = rows.select(*others, *(v.alias(k) for k, v in counts(text).items()))
    return counted.select(*others, *(v.alias(k) for k, v in shares().items()))
