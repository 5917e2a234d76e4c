"""Bindings of the operators to the tables of a star schema: in Spark, and as SQL for an independent check.

A listing is a line item with its part and supplier; rule lists are those of this data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import text as X
from shelfline.operators import pairs as pairing
from shelfline.operators import warehouse as WH
from shelfline.sources.snapshots import Snapshots
from shelfline.staging import fingerprint, shared_dir

BRANDS = [(f"brand#{n} ", f"Brand {n}") for n in (4, 19, 8, 2, 16)]
VARIANTS = [(["%hot%", "%c_ld%"], "Thermal"), (["%red%"], "Red"), (["%ring%"], "Ring")]
ALIASES = [("gizmo", "widget"), ("old", "aged")]
PHRASES = [b for b, _ in BRANDS]
HINTS = [("gear", "brand#4 "), ("plate", "brand#8 ")]
EXCLUSIVE = [("hot", "cold"), ("red", "blue"), ("small", "large"), ("old", "new")]
QUALIFIERS = ["ring", "anvil", "small"]
KEYWORDS = [("RING", "ring"), ("HOT", "hot"), ("HOT", "hot plate"), ("ROD", "rod"), ("RED ROD", "red rod")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    size = F.when(F.col("p_size") % 10 == 0, F.concat((F.col("p_size") / 10).cast("int").cast("string"), F.lit("L"))).when(F.col("p_size") % 7 == 0, "").otherwise(F.concat((F.col("p_size") * 10).cast("string"), F.lit(" ml")))
    return l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).select(
        F.col("l_orderkey").cast("string").alias("scrape_run_id"),
        F.col("s_name").alias("shop_name"),
        F.concat_ws(" ", "p_name", "p_brand", size).alias("product_name"),
        F.concat(F.lit("€ "), F.replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).alias("raw_price"),
        F.lit("EUR").alias("currency"),
        F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey").cast("string"), F.lit("?line="), F.col("l_linenumber").cast("string")).alias("product_url"),
        F.concat(F.lit("https://img.example/"), F.col("l_linenumber").cast("string")).alias("image_url"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WH.staging(listings(spark, sf_dir), brands=BRANDS, variants=VARIANTS)


def computed_comparison(spark: SparkSession, sf_dir: str, months: str = "latest") -> DataFrame:
    """The price comparison from raw listings."""
    s = staged(spark, sf_dir)
    return WH.price_comparison(WH.fact_price(s), WH.scd2_build(s)[1], months)


def comparison_table(spark: SparkSession, sf_dir: str) -> Snapshots:
    """The comparison of all months, kept by month in the shared folder: written when it is first asked for, and again
    when a file under it has changed."""
    sources = fingerprint(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier")))
    kept = WH.comparison_table(spark, f"{shared_dir(spark)}/comparison-{sources}")
    if kept.manifest() is None:
        kept.upsert(computed_comparison(spark, sf_dir, "all"), on_duplicate="unique")
    return kept


def comparison(spark: SparkSession, sf_dir: str, months: str = "latest") -> DataFrame:
    """The kept comparison; of the latest month only its part is read."""
    kept = comparison_table(spark, sf_dir)
    return kept.read_last() if months == "latest" else kept.read()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("product_name").distinct()


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as pairs are made of: day, base name, size, brand."""
    name = F.col("product_name")
    return listings(spark, sf_dir).select(X.date_of(F.col("scraped_at")).alias("day"), F.substring_index(name, " ", 2).alias("base"), X.volume_block_key(name).alias("size"), X.classify_brand(name, BRANDS, "UNKNOWN").alias("brand"), "shop_name", "product_name", "product_url", "image_url")


def pairs(spark: SparkSession, sf_dir: str, block: str) -> DataFrame:
    """Cross-shop pairs of one day and one base name (or size)."""
    return pairing.blocked_pairs(daily(spark, sf_dir), ["day", block], "shop_name", ["product_name"])


def met_names(spark: SparkSession, sf_dir: str, block: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """Names of those pairs, each two once, with `columns` of both. A base name or size follows from the name, so that names meet in one block only."""
    return pairing.distinct_pairs(daily(spark, sf_dir), [block], ["day"], "shop_name", "product_name", columns).drop(block)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embeddings of one label."""
    found = pairing.scored_pairs(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")
    return found.withColumn("cosine", X.round_half_up(F.col("cosine"), 4))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors as matched and labelled pairs."""
    total = F.col("id_1") + F.col("id_2")
    verdict = F.when(total % 5 == 0, F.lit(None)).when(total % 2 == 0, "SAME").otherwise("DIFFERENT")
    return vectors(spark, sf_dir).select("id_1", "id_2", F.col("cosine").alias("image_similarity"), X.round_half_up((F.col("id_1") % 21) / 21.0, 4).alias("name_similarity"), (F.col("cosine") >= 0.2).alias("is_match"), verdict.alias("ground_truth_verdict"), F.col("label").alias("computed_at"))


def edges(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    v = vectors(spark, sf_dir).filter(F.col("cosine") >= least)
    return v.select(F.col("id_1").cast("string").alias("a"), F.col("id_2").cast("string").alias("b"))


# The same in SQL.


def case(expr: str, rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({expr}), '{m}') THEN '{b}'" for m, b in rules) + f" ELSE '{other}' END"


def variant_case(expr: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"lower({expr}) LIKE '{p}'" for p in ps) + f" THEN '{v}'" for ps, v in VARIANTS) + " ELSE 'Koikuchi Shoyu' END"


def half_up(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * {float(10**digits)}::double + 0.5) / {float(10**digits)}::double)"


def uuid5(expr: str) -> str:
    h = f"sha1(unhex('{X.ID_SPACE}') || encode({expr}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def mean(col: str, digits: int = 2) -> str:
    return half_up(f"(cast(sum(cast({col} AS decimal(18,4))) AS double) / count({col}))", digits)


PRICE = "try_cast(trim(replace(replace(replace(replace(raw_price, '€', ''), 'EUR', ''), ' ', ''), ',', '.')) AS double)"
ML = r"try_cast(nullif(regexp_extract(product_name, '(\d+)\s*[Mm][Ll]', 1), '') AS bigint)"
LITRE = r"try_cast(nullif(regexp_extract(product_name, '(\d+(?:\.\d+)?)\s*[Ll]', 1), '') AS double)"
VOLUME = f"CASE WHEN {ML} IS NOT NULL THEN {ML} WHEN {LITRE} IS NOT NULL THEN cast(floor({LITRE} * 1000 + 0.5) AS bigint) ELSE 500 END"
KEY_L = [f"try_cast(nullif(regexp_extract(lower(product_name), '{p}', 1), '') AS bigint)" for p in ("([0-9]+)[ ]*(?:liter|litre)", "([0-9]+)[ ]*l[^a-z]", "([0-9]+)[ ]*l$")]
KEY = f"coalesce(cast(coalesce({', '.join(KEY_L)}) * 1000 AS varchar) || 'ml', nullif(replace(regexp_extract(lower(product_name), '([0-9]+[ ]*(?:ml|kg|g))', 1), ' ', ''), ''))"

LISTINGS = """listings AS (
  SELECT cast(l_orderkey AS varchar) AS scrape_run_id, s_name AS shop_name,
    p_name || ' ' || p_brand || ' ' || CASE WHEN p_size % 10 = 0 THEN cast(p_size // 10 AS varchar) || 'L' WHEN p_size % 7 = 0 THEN '' ELSE cast(p_size * 10 AS varchar) || ' ml' END AS product_name,
    '€ ' || replace(cast(cast(l_extendedprice AS decimal(12,2)) AS varchar), '.', ',') AS raw_price, 'EUR' AS currency,
    'https://shop.example/p/' || p_partkey || '?line=' || l_linenumber AS product_url, 'https://img.example/' || l_linenumber AS image_url, l_shipdate AS scraped_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
STAGED = f"""{LISTINGS},
staged AS (
  SELECT *, md5(product_name || '-' || shop_name || '-' || volume_ml) AS product_id, md5(product_name || '-' || shop_name || '-' || volume_ml) AS global_product_id,
    {half_up('price_eur * 100 / volume_ml', 4)} AS price_per_100ml_eur
  FROM (SELECT scrape_run_id, shop_name, product_name, {case('product_name', BRANDS, 'Other')} AS brand, {variant_case('product_name')} AS product_variant,
      {VOLUME} AS volume_ml, {PRICE} AS price_eur, currency, split_part(product_url, '?', 1) AS product_url, image_url, scraped_at
    FROM listings WHERE raw_price IS NOT NULL AND raw_price <> '')
  WHERE price_eur > 0 AND brand <> 'Other')"""
HISTORY = f"""{STAGED},
versions AS (
  SELECT product_id, global_product_id, shop_name, product_name, brand, product_variant, volume_ml, currency, product_url, image_url AS product_image_url,
    min(cast(scraped_at AS date)) AS valid_from, max(cast(scraped_at AS date)) AS valid_to
  FROM staged GROUP BY ALL),
history AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY valid_to DESC, valid_from DESC,
    CASE WHEN coalesce(product_image_url, '') = '' THEN 0 WHEN product_image_url LIKE '{{%' THEN 1 ELSE 2 END DESC,
    CASE WHEN coalesce(product_url, '') = '' THEN 0 ELSE 1 END DESC, product_url, product_image_url) = 1 AS is_latest
  FROM versions),
fact AS (SELECT scrape_run_id, product_id, price_eur, cast(scraped_at AS date) AS scrape_date FROM staged)"""
COMPARISON = f"""{HISTORY},
per_shop AS (
  SELECT d.global_product_id, d.shop_name, cast(date_trunc('month', scrape_date) AS date) AS scrape_month, max(d.product_url) AS product_url, max(d.brand) AS brand,
    max(d.product_name) AS product_name, max(d.volume_ml) AS volume_ml, {half_up('min(price_eur)', 2)} AS min_price_eur, {half_up('max(price_eur)', 2)} AS max_price_eur, {mean('price_eur')} AS avg_price_eur
  FROM fact JOIN (SELECT * FROM history WHERE is_latest) d USING (product_id) GROUP BY 1, 2, 3),
comparison_all AS (
  SELECT *, count(*) OVER (PARTITION BY global_product_id, scrape_month) AS shop_count, {half_up('avg_price_eur * 100 / nullif(volume_ml, 0)', 2)} AS avg_price_per_100ml FROM per_shop),
comparison AS (SELECT * FROM comparison_all WHERE scrape_month = (SELECT max(scrape_month) FROM comparison_all))"""
DAILY = f"""{LISTINGS},
daily AS (
  SELECT cast(scraped_at AS date) AS day, split_part(product_name, ' ', 1) || ' ' || split_part(product_name, ' ', 2) AS base, {KEY} AS size, {case('product_name', BRANDS, 'UNKNOWN')} AS brand,
    shop_name, product_name, product_url, image_url FROM listings)"""


def pairs_sql(block: str) -> str:
    return f"""{DAILY},
pairs AS (SELECT DISTINCT a.day, a.{block}, a.shop_name AS shop_name_1, a.product_name AS product_name_1, b.shop_name AS shop_name_2, b.product_name AS product_name_2
  FROM daily a JOIN daily b ON a.day = b.day AND a.{block} = b.{block} AND a.shop_name < b.shop_name)"""


VECTORS = f"""vectors AS (
  SELECT a.label, a.vec_id AS id_1, b.vec_id AS id_2, {half_up("greatest(0.0, least(1.0, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))))", 4)} AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"""
SCORED = f"""{VECTORS},
scored AS (
  SELECT id_1, id_2, cosine AS image_similarity, {half_up("(id_1 % 21) / 21.0::double", 4)} AS name_similarity, cosine >= 0.2 AS is_match,
    CASE WHEN (id_1 + id_2) % 5 = 0 THEN NULL WHEN (id_1 + id_2) % 2 = 0 THEN 'SAME' ELSE 'DIFFERENT' END AS ground_truth_verdict, label AS computed_at FROM vectors)"""
EDGES = f"""{VECTORS},
edges AS (SELECT cast(id_1 AS varchar) AS a, cast(id_2 AS varchar) AS b FROM vectors WHERE cosine >= 0.3)"""
# Min-label by recursion: every node that a node reaches.
ROOTS = f"""RECURSIVE {EDGES},
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""
