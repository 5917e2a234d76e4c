"""From listings to staged prices, facts and type-2 dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfline.functions import rules
from shelfline.functions import text as X
from shelfline.sources.snapshots import Snapshots

ATTRIBUTES = ["product_id", "global_product_id", "shop_name", "product_name", "brand", "product_variant", "volume_ml", "currency", "product_url", "product_image_url"]


def staging(listings: DataFrame, groups: DataFrame | None = None, brands: list = rules.BRANDS, variants: list = rules.VARIANTS) -> DataFrame:
    """Parsed listings of tracked brands with a valid price: ids, brand, variant, volume, prices.

    groups (shop_name, product_name, global_product_id) is last run's table of matched products.
    """
    name = F.col("product_name")
    parsed = listings.filter(X.non_blank(F.col("raw_price"))).select(
        "scrape_run_id",
        "shop_name",
        "product_name",
        X.classify_brand(name, brands).alias("brand"),
        X.classify_variant(name, variants).alias("product_variant"),
        X.volume_ml_default(name).alias("volume_ml"),
        X.parse_price(F.col("raw_price")).alias("price_eur"),
        F.lit("EUR").alias("currency"),
        X.strip_query(F.col("product_url")).alias("product_url"),
        "image_url",
        "scraped_at",
    )
    kept = parsed.filter((F.col("price_eur") > 0) & (F.col("brand") != "Other"))
    out = kept.withColumn("product_id", X.surrogate_key(name, F.col("shop_name"), F.col("volume_ml"))).withColumn("price_per_100ml_eur", X.price_per_100ml(F.col("price_eur"), F.col("volume_ml")))
    if groups is None:
        return out.withColumn("global_product_id", F.col("product_id"))
    g = groups.select("shop_name", "product_name", F.col("global_product_id").alias("_gid"))
    return out.join(g, ["shop_name", "product_name"], "left").withColumn("global_product_id", F.coalesce("_gid", "product_id")).drop("_gid")


def fact_price(staged: DataFrame) -> DataFrame:
    return staged.select("scrape_run_id", "product_id", "price_eur", X.date_of(F.col("scraped_at")).alias("scrape_date"))


def scd2_versions(staged: DataFrame) -> DataFrame:
    """One row for each combination of attributes, with the first and last day it was seen."""
    day = X.date_of(F.col("scraped_at"))
    return staged.withColumnRenamed("image_url", "product_image_url").groupBy(*ATTRIBUTES).agg(F.min(day).alias("valid_from"), F.max(day).alias("valid_to"))


def scd2_latest(versions: DataFrame) -> DataFrame:
    """versions with is_latest: the last seen, then the last begun, the best image, with an address; ties by the rest."""
    image, url = F.col("product_image_url"), F.col("product_url")
    quality = F.when(F.coalesce(image, F.lit("")) == "", 0).when(image.startswith("{"), 1).otherwise(2)
    has_url = F.when(F.coalesce(url, F.lit("")) == "", 0).otherwise(1)
    order = [F.desc("valid_to"), F.desc("valid_from"), quality.desc(), has_url.desc(), url, image, F.col("global_product_id"), F.col("brand"), F.col("product_variant"), F.col("currency")]
    return versions.withColumn("is_latest", F.row_number().over(W.partitionBy("product_id").orderBy(*order)) == 1)


def scd2_build(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, dimension of latest versions)."""
    history = scd2_latest(scd2_versions(staged))
    return history, history.filter("is_latest").drop("is_latest", "valid_from", "valid_to")


def money(c: Column) -> Column:
    """Amounts are added as decimals, so that sums don't depend on the order of rows."""
    return c.cast("decimal(18,4)")


def mean(c: Column) -> Column:
    """Mean of amounts, exact until the last division."""
    return F.sum(money(c)).cast("double") / F.count(c)


def price_comparison(fact: DataFrame, dim: DataFrame, months: str = "latest") -> DataFrame:
    """By matched product, shop and month: attributes, lowest, highest and mean price, price per 100 ml, number of shops."""
    month = X.month_of(F.col("scrape_date"))
    f = fact.select("product_id", "price_eur", month.alias("scrape_month"))
    if months == "latest":
        last = fact.agg(F.max(month).alias("_last"))
        f = f.join(F.broadcast(last), F.col("scrape_month") == F.col("_last"), "left_semi")
    d = dim.select("product_id", "global_product_id", "shop_name", "product_url", "brand", "product_name", "volume_ml")
    price = F.col("price_eur")
    per_shop = f.join(d, "product_id").groupBy("global_product_id", "shop_name", "scrape_month").agg(
        F.max("product_url").alias("product_url"),
        F.max("brand").alias("brand"),
        F.max("product_name").alias("product_name"),
        F.max("volume_ml").alias("volume_ml"),
        X.round_half_up(F.min(price), 2).alias("min_price_eur"),
        X.round_half_up(F.max(price), 2).alias("max_price_eur"),
        X.round_half_up(mean(price), 2).alias("avg_price_eur"),
    )
    shops = F.count("*").over(W.partitionBy("global_product_id", "scrape_month"))
    return per_shop.select("*", shops.alias("shop_count"), X.price_per_100ml(F.col("avg_price_eur"), F.col("volume_ml"), 2).alias("avg_price_per_100ml"))


def comparison_table(spark: SparkSession, path: str) -> Snapshots:
    """Where the comparison of all months is kept: parts by month, so that marts of one month read that part alone."""
    return Snapshots(spark, path, ["global_product_id", "shop_name", "scrape_month"], "scrape_month", "month")
