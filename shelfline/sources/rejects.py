"""What the readers of payloads don't take: each payload, product, element or page that gives no row, with its reason.

Rows in are rows out and rejects: every product of a feed is a listing or a reject, and so is every element of a map export and
every page; a payload that holds none of them is a reject itself (its pos is null). Titles that the caller filters out are no rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions import rules
from shelfline.functions import text as X
from shelfline.sources import listings as L
from shelfline.sources.tables import append_with_audit

_CORRUPT = "_corrupt"


def _read(payload: Column, schema: str) -> Column:
    """The document, permissively read, with what can't be read in a column of its own."""
    return F.from_json(payload, f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def _unread(payload: str) -> Column:
    return F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "empty payload").when(F.col(f"_doc.{_CORRUPT}").isNotNull() | F.col("_doc").isNull(), "malformed JSON")


def _told(payloads: DataFrame, parts: Column, bad: Column, key: str, payload: str, nothing: str) -> DataFrame:
    """(key, pos, reason, rejected) of payloads without parts, and of parts for which `bad` (over `_p`) tells a reason."""
    made = F.coalesce(parts, F.array().cast(payloads.select(parts.alias("p")).schema["p"].dataType))
    rows = payloads.select(key, F.col(payload).alias("_whole"), _unread(payload).alias("_reason"), F.posexplode_outer(F.when(_unread(payload).isNull(), made)).alias("pos", "_p"))
    reason = F.coalesce("_reason", F.when(F.col("pos").isNull(), nothing), bad)
    return rows.select(key, F.col("pos").cast("long").alias("pos"), reason.alias("reason"), F.when(F.col("pos").isNull(), F.col("_whole")).otherwise(F.to_json("_p")).alias("rejected")).filter("reason IS NOT NULL")


def feed_rejects(feeds: DataFrame, kind: str, key: str = "feed_id", payload: str = "payload") -> DataFrame:
    """(key, pos, reason, rejected) of product feeds: beside unreadable and empty payloads, products without variants, and cards' products
    whose title has come before in the payload."""
    df = feeds.select(key, payload, _read(F.col(payload), L.FEEDS[kind]).alias("_doc"))
    parts = F.when(F.col("_doc.product").isNotNull(), F.array("_doc.product")) if kind == "single" else L.products_of(F.col("_doc"), kind)
    bad = F.lit(None).cast("string")
    if kind in ("single", "list"):
        bad = F.when(F.coalesce(F.size("_p.variants"), F.lit(0)) <= 0, "no variants")
    told = _told(df, parts, bad, key, payload, "no products")
    if kind == "cards":
        rows = df.filter(_unread(payload).isNull()).select(key, F.posexplode(parts).alias("pos", "_p")).withColumn("_title", F.coalesce("_p.title", F.lit("")))
        first = rows.groupBy(key, "_title").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        again = rows.join(first, [key, "_title"]).filter("pos > _first").select(key, F.col("pos").cast("long").alias("pos"), F.lit("title again").alias("reason"), F.to_json("_p").alias("rejected"))
        told = told.unionByName(again)
    return told


def element_rejects(docs: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, pos, reason, rejected) of map exports: elements without a name, or that are no shop to keep."""
    df = docs.select(key, payload, _read(F.col(payload), L.ELEMENTS).alias("_doc"))
    tag = lambda k: F.coalesce(F.try_element_at(F.col("_p.tags"), F.lit(k)), F.lit(""))
    name = F.trim(tag("name"))
    kept = X.keyword_match(name, rules.SHOP_NAME_KEYWORDS) | X.keyword_match(F.lower(tag("cuisine")), rules.SHOP_CUISINE_KEYWORDS)
    return _told(df, F.col("_doc.elements"), F.when(name == "", "no name").when(~kept, "no shop to keep"), key, payload, "no elements")


def page_rejects(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, reason, rejected) of product pages that state no price."""
    priced = L.extract_product_page(pages.select(F.struct(key, url).alias("_u"), F.col(html).alias("_h")).select(F.to_json("_u").alias("_u"), "_h"), "_u", "_h").select(F.col("url").alias("_u"))
    rows = pages.select(key, F.to_json(F.struct(key, url)).alias("_u"), F.col(html).alias("_h"))
    reason = F.when(F.coalesce(F.trim("_h"), F.lit("")) == "", "empty page").otherwise("no price")
    return rows.join(priced.distinct(), "_u", "left_anti").select(key, F.lit(None).cast("long").alias("pos"), reason.alias("reason"), F.col("_h").alias("rejected"))


def quarantine(rejects: DataFrame, table: str, source: str, at: Column | None = None) -> None:
    """Append rejects, with where they come from and the run's time, to a table that holds those of all runs."""
    append_with_audit(rejects.withColumn("source", F.lit(source)), table, at)
