"""Filters, joins and groupings of listings, prices and pairs. DataFrames in, a DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfline.functions import text as X
from shelfline.functions.text import collation_order, shown_text
from shelfline.operators.ranks import positions
from shelfline.staging import staged


# Filters


def bronze_cast(df: DataFrame, columns: dict[str, tuple[str, str, int | None]]) -> DataFrame:
    """Rename, cast and cut only: new name to (column, type, most characters or None)."""
    return df.select(*((F.left(F.col(c).cast(t), F.lit(n)) if n else F.col(c).cast(t)).alias(new) for new, (c, t, n) in columns.items()))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns under new names, in order."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def facet_filter(df: DataFrame, **facets) -> DataFrame:
    """Equality on each column that is given and not None."""
    return reduce(lambda d, f: d.filter(F.col(f[0]) == f[1]), [f for f in facets.items() if f[1] is not None], df)


def shown_order(df: DataFrame, by: str, ascending: bool = True) -> list[Column]:
    """The order of any column's values as they are shown, numbers included: by the Unicode collation, digits as numbers."""
    keys = collation_order(shown_text(F.col(by), dict(df.dtypes)[by]))
    return [k.asc() if ascending else k.desc() for k in keys]


def search_and_sort(df: DataFrame, text: str, search: str, by: str, ascending: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose column holds the text, whatever its case, in the order of any column as it is shown: "Brand 2" before "brand
    10", "e" before "é" before "f", 1.5 before 1.25, and null among the words with n. Ties go by the columns of `then`."""
    return df.filter(F.lower(search).contains(text.lower())).orderBy(*shown_order(df, by, ascending), *then)


def search_and_rank(df: DataFrame, text: str, search: str, by: str, ascending: bool = True, then: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """search_and_sort's rows with their places, for pages of a long result."""
    return positions(df.filter(F.lower(search).contains(text.lower())), [*shown_order(df, by, ascending), *(F.col(c) for c in then)], place)


def latest_snapshot(df: DataFrame, by: Column) -> DataFrame:
    """Rows at the largest value: one row of it is broadcast."""
    last = df.agg(F.max(by).alias("_last"))
    return df.join(F.broadcast(last), by == F.col("_last"), "left_semi")


def valid_price_tracked_brand(df: DataFrame, price: str = "price_eur", brand: str = "brand", other: str = "Other") -> DataFrame:
    p = F.col(price)
    return df.filter(p.isNotNull() & ~F.isnan(p) & (p > 0) & (F.col(brand) != other))


def active_only(latest: DataFrame, deleted: str, required: str, missing: str | None = None) -> DataFrame:
    """Of latest rows those not deleted that have a required column, and lack another if asked."""
    out = latest.filter(F.col(deleted).isNull() & F.col(required).isNotNull())
    return out.filter(F.col(missing).isNull()) if missing else out


# Joins


def attach_global_id(df: DataFrame, groups: DataFrame, keys: list[str], group_id: str, fallback: str) -> DataFrame:
    """df with the group's id, or the fallback column's where there is none."""
    g = groups.select(*keys, F.col(group_id).alias("_gid"))
    return df.join(g, keys, "left").withColumn(group_id, F.coalesce("_gid", fallback)).drop("_gid")


def _key(*cols: str) -> Column:
    return F.struct(*(F.lower(F.trim(F.col(c))).alias(f"k{i}") for i, c in enumerate(cols)))


def resolve_ids(df: DataFrame, dim: DataFrame, cols: tuple[str, str], dim_cols: tuple[str, str], dim_id: str, out: str | None = None) -> DataFrame:
    """df with the id of a dimension, by names without case and outer blanks; a name of several products fans out.

    Where rows are to be paired, resolve them first: pairs of a block grow with the square of its rows, and then pass no join.
    """
    hit = dim.filter(F.col(dim_cols[0]).isNotNull() & F.col(dim_cols[1]).isNotNull()).select(F.lower(F.trim(F.col(dim_cols[0]))).alias("_a"), F.lower(F.trim(F.col(dim_cols[1]))).alias("_b"), F.col(dim_id).alias(out or dim_id))
    return df.join(hit, (F.lower(F.trim(F.col(cols[0]))) == F.col("_a")) & (F.lower(F.trim(F.col(cols[1]))) == F.col("_b")), "left").drop("_a", "_b")


def resolve_pair_ids(pairs: DataFrame, dim: DataFrame, sides: tuple[tuple[str, str], tuple[str, str]], dim_cols: tuple[str, str], dim_id: str) -> DataFrame:
    """pairs that are given with id_1 and id_2 from a dimension: see resolve_ids."""
    return reduce(lambda p, side: resolve_ids(p, dim, side[1], dim_cols, dim_id, f"{dim_id}_{side[0]}"), enumerate(sides, 1), pairs)


def spelled_once(df: DataFrame, columns: list[str], out: str, most_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """df with `out`: whether no text of the columns occurs in another spelling that is equal to it without case and outer blanks; and
    whether that holds for all rows. Texts that upper and lower case don't bring back are taken for such ones."""
    df, all_once = df.withColumn(out, F.lit(True)), True
    for name in columns:
        text = F.col(name)
        plain = F.lower(F.trim(text))
        forms = df.select(name).distinct().withColumn("_k", F.lower(F.upper(plain)))
        several = forms.groupBy("_k").agg(F.count(name).alias("_n")).filter("_n > 1").select("_k")
        odd = staged(forms.join(several, "_k", "left_semi").select(name).union(forms.filter(plain != F.lower(F.trim(F.upper(text)))).select(name)).distinct(), "spellings")
        if n := odd.count():
            few = odd.withColumn("_odd", F.lit(True))
            df, all_once = df.join(F.broadcast(few) if n <= most_rows else few, name, "left").withColumn(out, F.col(out) & F.col("_odd").isNull()).drop("_odd"), False
    return df, all_once


def unordered_key(left: list[str], right: list[str]) -> Column:
    """One key of a pair in either direction, without case and outer blanks; null if a part is null."""
    parts = [F.col(c) for c in (*left, *right)]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.sort_array(F.array(_key(*left), _key(*right))))


def join_unordered_pairs(scores: DataFrame, labels: DataFrame, left: list[str], right: list[str], verdict: str = "verdict", agreed: str | None = "manual_check", out: str = "ground_truth_verdict") -> DataFrame:
    """scores with the verdict of labels that name the pair in either direction: an equi-join on one sorted key.

    Only labels whose verdict agrees with the checked one count. Repeated labels of a pair repeat its row: see dedup_labels.
    """
    if agreed:
        labels = labels.filter(F.upper(verdict) == F.upper(agreed))
    told = labels.select(unordered_key(left, right).alias("_k"), F.col(verdict).alias(out)).filter("_k IS NOT NULL")
    return scores.withColumn("_k", unordered_key(left, right)).join(told, "_k", "left").drop("_k")


def dedup_labels(labels: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """One label for each pair, whatever its direction: the first in order."""
    w = W.partitionBy(unordered_key(left, right)).orderBy(*order)
    return labels.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def anti_join_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What hasn't been done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def enrich_dim(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """df with a small dimension's columns; it is broadcast only if a count shows that it is small."""
    small = F.broadcast(dim) if dim.limit(most_rows + 1).count() <= most_rows else dim
    return df.join(small, keys, how)


# Groupings


def dedup_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a stated order, by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def latest_non_null(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's last value that isn't null."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def count_over(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.count("*").over(W.partitionBy(*keys)))


def facet_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value) of the distinct values of columns, in order: one scan, and one shuffle of distinct pairs."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.facet", "p.value").distinct().orderBy("facet", "value")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def price_trend(df: DataFrame, month: str, product: str, price: str, products: list | None = None) -> DataFrame:
    """month by product: the lowest price where a product has several (the last one of a list ordered by falling price)."""
    return df.groupBy(month).pivot(product, products).agg(F.min(price))


def family_of(product: Column, families: Column | int) -> Column:
    """A product's column family, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(product.cast("binary")), 1, 8), 16, 10).cast("long") % families


def price_trend_by_product(df: DataFrame, month: str, product: str, price: str, per_family: int = 1000) -> DataFrame:
    """(month, family, prices): the trend by product where products are more than columns may be.

    Products are dealt by hash to as many column families as hold about `per_family` each; a month's row of a family is a map from product to its
    lowest price, so that a row's size is bounded whatever the number of products. Null products are left out.
    """
    least = df.filter(F.col(product).isNotNull()).groupBy(month, product).agg(F.min(price).alias("_p"))
    families = df.agg(F.greatest(F.lit(1), F.ceil(F.countDistinct(product) / per_family)).cast("long").alias("_families"))
    dealt = least.crossJoin(F.broadcast(families)).withColumn("family", family_of(F.col(product), F.col("_families")))  # one row
    return dealt.groupBy(month, "family").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(product, "_p")))).alias("prices"))


def rounded(c: Column, digits: int = 2) -> Column:
    return X.round_half_up(c, digits)
