"""Data-quality checks: all checks of a table in one pass over it, as rows (check_name, failures)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A check of rows (`failed` is true), or of keys (groups of equal keys with more than one row fail)."""

    name: str
    failed: Column | None = None
    keys: tuple[str, ...] = ()
    nulls: bool = True  # whether null is a value of a key


def is_not_null(column: str) -> Check:
    return Check(f"not_null_{column}", F.col(column).isNull())


def is_accepted(column: str, values: list) -> Check:
    """The value is in the list; null passes."""
    return Check(f"accepted_values_{column}", ~F.col(column).isin(values))


def is_between(column: str, least: float, most: float) -> Check:
    """The value is within bounds, which are accepted themselves; null passes."""
    return Check(f"accepted_range_{column}", ~F.col(column).between(least, most))


def is_unique(column: str) -> Check:
    """Values other than null occur once."""
    return Check(f"unique_{column}", keys=(column,), nulls=False)


def are_unique(columns: list[str]) -> Check:
    """Combinations occur once; null is a value."""
    return Check("unique_combination_" + "_".join(columns), keys=tuple(columns))


def fused(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check_name, failures) of all checks by one scan, and one exchange of the keys of all uniqueness checks together.

    Each row gives an entry for each uniqueness check, its key, and one for the checks of rows, their flags; entries are
    counted by check and key, combined before they are shuffled, so that flags cross as one row for each task.
    """
    rows = [c for c in checks if c.failed is not None]
    keyed = [c for c in checks if c.failed is None]
    flags = [F.coalesce(c.failed, F.lit(False)).cast("long") for c in rows]
    if keyed:
        none = F.lit(None).cast("array<string>")
        empty = F.array(*(F.lit(0).cast("long") for _ in rows)).cast("array<bigint>")
        entry = lambda n, key, own: F.struct(F.lit(n).alias("n"), key.alias("key"), own.alias("flags"))
        entries = [entry(-1, none, F.array(*flags))] if rows else []
        for n, c in enumerate(keyed):
            made = entry(n, F.array(*(F.col(k).cast("string") for k in c.keys)), empty)
            entries.append(made if c.nulls else F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in c.keys)), made))
        counted = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.n", "e.key").agg(F.count("*").alias("times"), *(F.sum(F.get("e.flags", F.lit(j))).alias(f"f{j}") for j in range(len(rows))))
        failures = [F.coalesce(F.sum(f"f{j}"), F.lit(0)) for j in range(len(rows))]
        whole = counted.agg(*(f.alias(f"r{j}") for j, f in enumerate(failures)), *(F.count_if((F.col("n") == n) & (F.col("times") > 1)).alias(f"k{n}") for n in range(len(keyed))))
    else:
        whole = df.agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f"r{j}") for j, f in enumerate(flags)))
    names = [(c.name, f"r{j}") for j, c in enumerate(rows)] + [(c.name, f"k{n}") for n, c in enumerate(keyed)]
    return whole.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(at).alias("failures")) for name, at in names))).alias("r")).select("r.*")


def watched(df: DataFrame, checks: list[Check], name: str = "checks") -> tuple[DataFrame, Observation]:
    """df as it is, with an observation that counts failures of row checks as df is written: no pass of their own."""
    if any(c.failed is None for c in checks):
        raise ValueError("only checks of rows can be watched")
    told = Observation(name)
    return df.observe(told, *(F.coalesce(F.sum(F.coalesce(c.failed, F.lit(False)).cast("long")), F.lit(0)).alias(c.name) for c in checks)), told


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return fused(df, [is_not_null(c) for c in columns])


def unique(df: DataFrame, column: str) -> DataFrame:
    return fused(df, [is_unique(column)])


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return fused(df, [is_accepted(column, values)])


def accepted_range(df: DataFrame, column: str, least: float, most: float) -> DataFrame:
    return fused(df, [is_between(column, least, most)])


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return fused(df, [are_unique(columns)])


def run_checks(models: list[tuple[str, DataFrame, list[Check]]]) -> DataFrame:
    """(model, check_name, failures, status) of each model's checks. Models of one frame are checked in one pass."""
    frames: list[tuple[DataFrame, list[tuple[str, Check]]]] = []
    for model, df, checks in models:
        own = next((c for d, c in frames if d is df), None)
        if own is None:
            frames.append((df, own := []))
        own.extend((model, c) for c in checks)
    one = lambda df, named: fused(df, [Check(f"{m}\n{c.name}", c.failed, c.keys, c.nulls) for m, c in named])
    rows = reduce(lambda a, b: a.unionByName(b), [one(df, named) for df, named in frames])
    told = rows.select(F.substring_index("check_name", "\n", 1).alias("model"), F.substring_index("check_name", "\n", -1).alias("check_name"), "failures")
    return told.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def check_summary(results: DataFrame, layers: tuple[str, ...] = ("raw", "staging", "dim", "fact", "datamart")) -> DataFrame:
    """Totals by layer, which is the first part of a model's name, or other."""
    head = F.substring_index("model", "_", 1)
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(F.when(head.isin(*layers), head).otherwise("other").alias("layer")).agg(F.count("*").alias("total"), count("pass").alias("passed"), count("fail").alias("failed"), count("warn").alias("warned"), F.countDistinct("model").alias("models"))
