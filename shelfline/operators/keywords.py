"""Joins of names with the keywords that they contain, by an inverted index: no keyword meets a name that lacks its rarest gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.staging import staged


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of a size; none if the text is shorter, and one empty one of size 0."""
    size = F.lit(size) if isinstance(size, int) else size
    n = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size))
    none = F.array().cast("array<string>")
    return F.when(size == 0, F.array(F.lit(""))).when(n > 0, F.array_distinct(cut)).otherwise(none)


def contained(names: DataFrame, name: str, dictionary: DataFrame, keyword: str, size: int = 3) -> DataFrame:
    """(name, keyword) of each distinct name and each distinct keyword in it.

    Each keyword is filed under that of its grams of `size` characters (shorter keywords: their own length) which
    the fewest names have. Names meet keywords by that one gram, an equi-join, and `contains` confirms. A keyword with a gram that no
    name has is in none, and is filed nowhere. Counts of grams are combined before they are shuffled.
    """
    texts = staged(names.select(F.col(name).alias("_name")).filter("_name IS NOT NULL").distinct(), "names")
    words = staged(dictionary.select(F.col(keyword).alias("_word")).filter("_word IS NOT NULL").distinct(), "keywords")
    own = F.least(F.lit(size), F.length("_word"))
    sizes = sorted(r[0] for r in words.select(own.alias("n")).distinct().collect())  # at most size + 1 values
    if not sizes:
        return texts.select(F.col("_name").alias(name), F.lit(None).cast("string").alias(keyword)).filter("false")
    of_name = texts.select("_name", F.explode(F.flatten(F.array(*(grams(F.col("_name"), n) for n in sizes)))).alias("_gram"))
    of_word = words.select("_word", grams(F.col("_word"), own).alias("_grams")).select("_word", F.size("_grams").alias("_n"), F.explode("_grams").alias("_gram"))
    counts = of_name.groupBy("_gram").agg(F.count("*").alias("_names"))
    filed = of_word.join(counts, "_gram").groupBy("_word").agg(F.count("*").alias("_met"), F.first("_n").alias("_n"), F.min_by("_gram", F.struct("_names", "_gram")).alias("_gram")).filter("_met = _n").select("_word", "_gram")
    met = of_name.join(filed, "_gram").filter(F.contains("_name", F.col("_word")))
    return met.select(F.col("_name").alias(name), F.col("_word").alias(keyword))


def dictionary_join(df: DataFrame, name: str, dictionary: DataFrame, keyword: str, label: str, unknown: list[str] = (), other: str = "UNKNOWN") -> DataFrame:
    """df with the label of the longest keyword that a name has, whatever their case (ties by label, then keyword); none and
    listed names are `other`. Null labels and keywords count as absent."""
    words = dictionary.select(F.lower(keyword).alias("_k"), F.col(label).alias("_label")).dropna().groupBy("_k").agg(F.min("_label").alias("_label"))
    hits = contained(df.select(F.lower(name).alias("_key")), "_key", words, "_k").join(words, "_k")
    best = hits.groupBy("_key").agg(F.min(F.struct((-F.length("_k")).alias("l"), "_label", "_k")).alias("_best")).select("_key", F.col("_best._label").alias("_label"))
    listed = F.coalesce(F.col(name).isin(list(unknown)), F.lit(False)) if unknown else F.lit(False)
    found = df.join(best, F.lower(name) == F.col("_key"), "left")
    return found.withColumn(label, F.when(listed, other).otherwise(F.coalesce("_label", F.lit(other)))).drop("_key", "_label")
