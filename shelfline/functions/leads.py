"""Column functions over conversations and lead scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import rules
from shelfline.functions.text import round_half_up

TURNS = "array<struct<role:string,text:string>>"


def first_json_object(text: Column, schema: str) -> Column:
    """The object from the first { to the last }, of a code fence's inside where there is one; null if it doesn't parse."""
    parts = F.split(text, "```")
    inside = F.when(F.size(parts) > 1, F.regexp_replace(F.get(parts, F.lit(1)), "^json", "")).otherwise(text)
    return F.from_json(F.nullif(F.regexp_extract(inside, r"(?s)[{].*[}]", 0), F.lit("")), schema)


def propensity_score(scores: Column, weights: dict[str, float] = rules.WEIGHTS) -> Column:
    """Weighted mean of scores 1 to 5 (a map by dimension), as 0 to 100; null if a dimension is missing."""
    raw = reduce(lambda a, b: a + b, [F.try_element_at(scores, F.lit(k)) * w for k, w in weights.items()])
    return round_half_up((raw - 1) / 4 * 100, 1)


def propensity_label(score: Column, labels: list[tuple[int, int, str]] = rules.LABELS) -> Column:
    """Label of the band that holds the score, bounds included; between bands it is Unknown."""
    out = F.lit("Unknown")
    for low, high, label in labels:
        out = F.when(score.between(low, high), label).otherwise(out)
    return out


def breakdown_json(breakdown: Column) -> Column:
    return F.to_json(breakdown)


def prompt_text(history: Column) -> Column:
    """The user's turns, numbered, one on a line."""
    told = F.array_join(F.transform(F.filter(history, lambda t: t["role"] == "user"), lambda t, i: F.concat(F.lit("User message "), (i + 1).cast("string"), F.lit(": "), t["text"])), "\n")
    return F.when(F.trim(F.coalesce(told, F.lit(""))) == "", rules.EMPTY_CONVERSATION).otherwise(told)


def fallback_history(conversation: Column, reason: Column, fields: list[tuple[Column, str, str]], default: str) -> Column:
    """The stored conversation; else one made of the reason's parts and of fields (value, text before, text after); else one turn."""
    stored = F.from_json(conversation, TURNS)
    said = lambda t: F.struct(F.lit("user").alias("role"), t.alias("text"))
    reasons = F.transform(F.filter(F.transform(F.coalesce(F.split(reason, " / "), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), said)
    told = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")).isin("", rules.NOT_MENTIONED), None).otherwise(said(F.concat(F.lit(a), c, F.lit(b)))) for c, a, b in fields)))
    made = F.concat(reasons, told)
    return F.when(F.size(stored) > 0, stored).when(F.size(made) > 0, made).otherwise(F.array(said(F.lit(default))))
