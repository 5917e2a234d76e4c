"""Quality rules with adaptive thresholds, by DataFrame functions alone.

Each text's counts are taken once and kept in a staged table. For every language and source a KLL sketch of each statistic
is made; sketches merge upwards, by language and over all. A group's thresholds are fences around its quartiles,
q25 - reach * spread and q75 + reach * spread, where the spread is q75 - q25 or the statistic's least spread; a group of
fewer than `least_rows` texts takes those of its language, and then those of all. Documents and thresholds are joined;
thresholds are broadcast only after a count shows at most `most_broadcast` groups, else the join shuffles.

Sketches keep up to a few hundred values exactly; beyond, their quantiles vary by about 1 % of the ranks between runs,
so that a text right at a fence may change sides.

Defined results: null and empty texts have no words and fail the base rule; null language or source is a group of its
own; repeated documents each get a row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.llm.statistics import words_of

WINDOW = 5
#: Each statistic's least spread: how far apart quartiles count as at the least.
LEAST_SPREAD = {"word_length": 1.0, "symbol_share": 0.04, "repeated_line_share": 0.1, "repeated_word_share": 0.05}
#: Statistics that have a lower fence too.
TWO_SIDED = {"word_length"}


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words stand in n-word windows that the text has twice or more, the first of each included."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))

    def covered(grams: Column) -> Column:
        # Windows sorted by hash: one is repeated if a neighbour is equal. Then back in order of place.
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
            marked = F.zip_with(s, before, lambda x, y: F.struct(x["g"].alias("g"), x["i"].alias("i"), F.coalesce(x["g"] == y["g"], F.lit(False)).alias("twice")))
            kept = F.zip_with(marked, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["twice"] | F.coalesce(x["g"] == y["g"], F.lit(False)), x["i"]))
            return F.sort_array(F.array_compact(kept))

        # Each window adds its words beyond the end of the window before.
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["total"] + n - F.greatest(F.lit(0), a["end"] - i)).alias("total"), (i + n).alias("end"))
        return F.aggregate(C.let(placed, places), start, step, lambda a: a["total"])

    def counted(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered(grams)).otherwise(0)

    return C.let(words, lambda w: F.when(F.size(w) > n, C.let(windows(w), counted)).otherwise(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return C.let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def text_counts(documents: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"), words_of(text).alias("words"))
    return rows.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit("[\\x20\\x09-\\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
    )


def statistics() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "repeated_line_share": share("n_dup_lines", "n_lines"), "repeated_word_share": share("n_repeat_words", "n_words")}


def thresholds(counts: DataFrame, k: int, reach: float, least_rows: int) -> DataFrame:
    """(lang, source, low_<statistic>, high_<statistic>) for each group of counts."""
    names = list(LEAST_SPREAD)
    sketch = [F.kll_sketch_agg_double(v, F.lit(k)).alias(n) for n, v in statistics().items()]
    groups = C.staged(counts.groupBy("lang", "source").agg(F.count("*").alias("rows"), *sketch), "sketches")
    merged = [F.kll_merge_agg_double(n, F.lit(k)).alias(n) for n in names]
    by_lang = groups.groupBy("lang").agg(F.sum("rows").alias("rows"), *merged)
    over_all = groups.agg(F.sum("rows").alias("rows"), *merged)
    joined = groups.alias("g").join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").crossJoin(F.broadcast(over_all).alias("a"))  # one row

    def fence(n: str, rank: float, sign: int) -> Column:
        pick = F.when(F.col("g.rows") >= least_rows, F.col(f"g.{n}")).when(F.col("l.rows") >= least_rows, F.col(f"l.{n}")).otherwise(F.col(f"a.{n}"))
        q = lambda r: F.kll_sketch_get_quantile_double(pick, F.lit(r))
        return q(rank) + sign * reach * F.greatest(q(0.75) - q(0.25), F.lit(LEAST_SPREAD[n]))

    highs = [fence(n, 0.75, 1).alias(f"high_{n}") for n in names]
    lows = [fence(n, 0.25, -1).alias(f"low_{n}") for n in names if n in TWO_SIDED]
    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *highs, *lows)


def apply_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", k: int = 400, reach: float = 3.0, least_rows: int = 100, most_broadcast: int = 50_000) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept."""
    counts = C.staged(text_counts(documents, id_col, text_col, lang_col, source_col), "text-counts")
    limits = C.staged(thresholds(counts, k, reach, least_rows), "thresholds")
    small = F.broadcast(limits) if limits.count() <= most_broadcast else limits
    joined = counts.alias("c").join(small.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")) & F.col("c.source").eqNullSafe(F.col("t.source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = F.lit(True)
    for n, v in statistics().items():
        within = within & (v <= F.col(f"high_{n}"))
        if n in TWO_SIDED:
            within = within & (v >= F.col(f"low_{n}"))
    return joined.select(F.col("c.id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(True))).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(C.table(spark, sf_dir, "documents"))
