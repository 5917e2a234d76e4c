"""Raw payloads to listings: CSV exports, product feeds, product pages, map elements.

A listing has shop_name, product_name, raw_price, currency, product_url and image_url, all text. HTML is read with regular
expressions in the JVM: enough for the fixed marks that shops use, and whole pages never leave Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions import rules
from shelfline.functions import text as X

LISTING = ["shop_name", "product_name", "raw_price", "currency", "product_url", "image_url"]
CSV_COLUMNS = ["scrape_run_id", "shop_name", "product_name", "raw_price", "currency", "product_url", "image_url", "scraped_at"]


def read_listing_csv(spark: SparkSession, path: str, required: list[str] = CSV_COLUMNS, optional: tuple[str, ...] = ("image_url",)) -> DataFrame:
    """A CSV with a header, all text; blanks stay empty texts; missing optional columns are empty, others an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in df.columns and c not in optional]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in required))


def read_label_csv(spark: SparkSession, path: str, n_cols: int = 9) -> DataFrame:
    """A CSV's first columns with tidy names; values stripped, blank is null."""
    return tidy_labels(spark.read.csv(path, header=True, multiLine=True, escape='"'), n_cols)


def tidy_labels(df: DataFrame, n_cols: int = 9) -> DataFrame:
    first = df.columns[:n_cols]
    return df.select(*(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c.strip().lower().replace(" ", "_")) for c in first))


_VARIANTS, _IMAGES = "variants array<struct<price:string>>", "images array<struct<src:string,url:string>>"
FEEDS = {
    "single": f"product struct<title:string,handle:string,{_VARIANTS.replace(' ', ':', 1)},{_IMAGES.replace(' ', ':', 1)}>",
    "list": f"products array<struct<title:string,handle:string,{_VARIANTS.replace(' ', ':', 1)},{_IMAGES.replace(' ', ':', 1)}>>",
    "search": "resources struct<results:struct<products:array<struct<title:string,price:string,url:string,featured_image:string>>>>",
    "cards": "cards array<struct<products:array<struct<title:string,price:struct<now:string>,images:array<struct<url:string>>,link:string>>>>, products array<struct<title:string,price:struct<now:string>,images:array<struct<url:string>>,link:string>>",
}


def _money(c: Column) -> Column:
    return F.coalesce(F.format_string("€%.2f", c.try_cast("double")), F.lit(""))


_CARD = "array<struct<title:string,price:struct<now:string>,images:array<struct<url:string>>,link:string>>"


def products_of(doc: Column, kind: str) -> Column:
    """The products of a list, a search result, or cards (of all cards; only if these hold none, the payload's own)."""
    if kind == "cards":
        cards = F.flatten(F.transform(doc["cards"], lambda c: F.coalesce(c["products"], F.array().cast(_CARD))))
        return F.when(F.size(cards) > 0, cards).otherwise(doc["products"])
    return doc["products"] if kind == "list" else doc["resources"]["results"]["products"]


def parse_product_feed(feeds: DataFrame, kind: str, keep=None, sizes: list[str] | None = None, key: str = "feed_id", shop: str = "shop_name", base: str = "base_url", payload: str = "payload") -> DataFrame:
    """Listings of JSON payloads (feed_id, shop_name, base_url, payload) of one kind: single, list, search or cards.

    keep(title) filters titles. With sizes, only each size's first product whose title has it stays. Cards keep each
    title's first product. Malformed payloads give no rows; what isn't taken is told by sources.rejects.
    """
    doc = feeds.select(key, shop, F.regexp_replace(F.col(base), "/+$", "").alias("base"), F.from_json(payload, FEEDS[kind]).alias("d"))
    if kind == "single":
        rows = doc.select(key, shop, "base", F.lit(0).alias("pos"), F.col("d.product").alias("p")).filter("p IS NOT NULL")
    else:
        rows = doc.select(key, shop, "base", F.posexplode(products_of(F.col("d"), kind)).alias("pos", "p"))
    absolute = lambda url: F.when((url == "") | url.startswith("http"), url).otherwise(F.concat("base", url))
    title = F.coalesce(F.col("p.title"), F.lit(""))
    if kind in ("single", "list"):
        rows = rows.filter(F.size(F.col("p.variants")) > 0)
        price = F.concat(F.lit("€"), F.coalesce(F.get(F.col("p.variants"), F.lit(0))["price"], F.lit("")))
        url = F.concat_ws("", F.col("base"), F.lit("/products/"), F.coalesce(F.col("p.handle"), F.lit("")))
        image = F.coalesce(F.get(F.col("p.images"), F.lit(0))["src"], F.lit(""))
    elif kind == "search":
        price = F.when(F.coalesce(F.col("p.price"), F.lit("")) == "", "").otherwise(F.concat(F.lit("€"), F.col("p.price")))
        url = absolute(F.coalesce(F.col("p.url"), F.lit("")))
        raw = F.col("p.featured_image")
        image = F.coalesce(F.when(raw.startswith("{"), F.get_json_object(raw, "$.url")).otherwise(raw), F.lit(""))
    else:
        price = _money(F.col("p.price.now"))
        link = F.coalesce(F.col("p.link"), F.lit(""))
        url = F.when(link == "", "").otherwise(F.concat("base", link))
        image = F.coalesce(F.get(F.col("p.images"), F.lit(0))["url"], F.lit(""))
    out = rows.select(key, "pos", F.col(shop).alias("shop_name"), title.alias("product_name"), price.alias("raw_price"), F.lit("EUR").alias("currency"), url.alias("product_url"), image.alias("image_url"))
    if keep is not None:
        out = out.filter(keep(F.col("product_name")))
    if sizes and kind in ("list", "search"):
        sized = out.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter(F.lower("product_name").contains(F.col("size")))
        out = first_per_key(sized, [key, "size"], ["pos"]).drop("size")
    if kind == "cards":
        out = first_per_key(out, [key, "product_name"], ["pos"])
    return out.select(key, *LISTING)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order, by a map-side combined minimum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def _unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&euro;", "€"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inner_text(html: Column) -> Column:
    """Text of a piece of HTML: tags out, entities read, ends trimmed."""
    return F.trim(_unescape(F.regexp_replace(html, "<[^>]*>", "")))


def _tag_attr(html: Column, tag: str, mark: str, attr: str) -> Column:
    """An attribute of the first such tag that has a mark, whatever the order of attributes."""
    found = F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b(?=[^>]*\b{mark})[^>]*>", 0), F.lit(""))
    return _unescape(F.nullif(F.regexp_extract(found, rf"(?is)\b{attr}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")))


def _span(html: Column, mark: str) -> Column:
    """Contents of all spans that have a mark."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<span\b(?=[^>]*\b{mark})[^>]*>(.*?)</span>"), F.lit(1))


def _number(c: Column) -> Column:
    bare = F.trim(F.replace(F.regexp_replace(inner_text(c), "[€\\x{A0}]", ""), F.lit(","), F.lit(".")))
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))


_LD = "array<struct<`@type`:string,name:string,image:string,offers:string,price:string,lowPrice:string,priceCurrency:string>>"
_OFFER = "array<struct<price:string,lowPrice:string,priceCurrency:string>>"


def _as_list(text: Column, schema: str) -> Column:
    """JSON that is one object or a list of them."""
    t = F.trim(text)
    return F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), schema)


def extract_product_page(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, product_name, raw_price, currency, image_url) of pages that state a price; others give no row.

    Prices in order: itemprop meta; first shop span; `Price1_inc` span over nought; first `item-price` span over nought;
    JSON-LD of a product or an offer, which may also name the product, the currency and the image.
    """
    h = F.col(html)
    domain = F.regexp_extract(F.col(url), r"^[a-z]+://([^/]+)", 1)
    images = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), _unescape)
    own = F.filter(images, lambda s: s.contains(domain) & F.lower(s).rlike(r"\.(jpg|jpeg|png|webp)$"))
    scripts = F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    items = F.flatten(F.transform(scripts, lambda s: F.coalesce(_as_list(s, _LD), F.array().cast(_LD))))

    def offer(i: Column) -> Column:
        own_offer = F.struct(i["price"].alias("price"), i["lowPrice"].alias("lowPrice"), i["priceCurrency"].alias("priceCurrency"))
        return F.when(i["offers"].isNull(), own_offer).otherwise(F.get(_as_list(i["offers"], _OFFER), F.lit(0)))

    def told(i: Column) -> Column:
        o = offer(i)
        image = i["image"]
        first = F.when(image.startswith("["), F.coalesce(F.get_json_object(image, "$[0].url"), F.get_json_object(image, "$[0]"))).when(image.startswith("{"), F.coalesce(F.get_json_object(image, "$.url"), F.get_json_object(image, "$.contentUrl"))).otherwise(image)
        price = F.coalesce(F.nullif(o["price"], F.lit("")), o["lowPrice"]).try_cast("double")
        return F.struct(price.alias("price"), F.coalesce(o["priceCurrency"], F.lit("EUR")).alias("currency"), i["name"].alias("name"), first.alias("image"))

    offers = F.filter(F.transform(F.filter(items, lambda i: i["@type"].isin("Product", "Offer")), told), lambda o: o["price"] != 0)
    positive = lambda spans: F.get(F.filter(F.transform(spans, _number), lambda p: p > 0), F.lit(0))
    rows = pages.select(
        F.col(url).alias("url"),
        F.coalesce(F.nullif(inner_text(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit("")), F.col(url)).alias("title"),
        F.coalesce(_tag_attr(h, "meta", r"property\s*=\s*[\"']og:image[\"']", "content"), F.get(own, F.lit(0)), F.lit("")).alias("image"),
        F.coalesce(
            _tag_attr(h, "meta", r"itemprop\s*=\s*[\"']price[\"']", "content").try_cast("double"),
            _number(F.get(_span(h, r"class\s*=\s*[\"'][^\"']*\bwoocommerce-Price-amount\b"), F.lit(0))),
            positive(F.slice(_span(h, r"id\s*=\s*[\"']Price1_inc[\"']"), 1, 1)),
            positive(_span(h, r"class\s*=\s*[\"'][^\"']*\bitem-price\b")),
        ).alias("price"),
        F.get(offers, F.lit(0)).alias("ld"),
    )
    by_ld = F.col("price").isNull()
    return rows.filter("price IS NOT NULL OR ld IS NOT NULL").select(
        "url",
        F.when(by_ld, F.coalesce("ld.name", "title")).otherwise(F.col("title")).alias("product_name"),
        F.format_string("€%.2f", F.coalesce("price", "ld.price")).alias("raw_price"),
        F.when(by_ld, F.col("ld.currency")).otherwise("EUR").alias("currency"),
        F.when(by_ld, F.coalesce(F.nullif(F.col("ld.image"), F.lit("")), F.col("image"))).otherwise(F.col("image")).alias("image_url"),
    )


def page_titles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title) of each page's first h1, without tags; null without one."""
    return pages.select(key, F.nullif(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""), F.lit("")).alias("title"))


def find_listing_links(pages: DataFrame, keep=None, base: Column | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, link_text) of links whose text passes keep(); with a base, relative addresses become absolute."""
    pattern = r"(?is)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"[^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("body"))
    origin = F.lit("") if base is None else base
    rows = pages.select(key, origin.alias("_base"), F.posexplode(both).alias("pos", "a"))
    href = F.col("a.href")
    rows = rows.select(key, "pos", F.when(href.startswith("http"), href).otherwise(F.concat("_base", href)).alias("href"), F.trim(F.regexp_replace("a.body", "<[^>]*>", "")).alias("link_text"))
    return rows if keep is None else rows.filter(keep(F.col("link_text")))


def first_priced_link(links: DataFrame, prices: DataFrame, key: str = "page_id") -> DataFrame:
    """Each page's first link that leads to a page with a price; prices has url and more."""
    joined = links.join(prices, links["href"] == prices["url"])
    return first_per_key(joined, [key], ["pos"])


ELEMENTS = "elements array<struct<id:string,type:string,tags:map<string,string>>>"


def parse_osm_elements(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Shops of map exports {elements: [{id, type, tags}]}: those with a name that looks like a shop to keep."""
    rows = docs.select(F.posexplode(F.from_json(payload, ELEMENTS)["elements"]).alias("pos", "e"))
    tag = lambda k: F.coalesce(F.try_element_at(F.col("e.tags"), F.lit(k)), F.lit(""))
    first = lambda *ks: F.coalesce(*(F.nullif(tag(k), F.lit("")) for k in ks), F.lit(""))
    shops = rows.select(
        "pos",
        F.trim(tag("name")).alias("name"),
        F.trim(F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber"))).alias("address"),
        first("website", "url", "contact:website").alias("website"),
        first("phone", "contact:phone").alias("phone"),
        F.lower(tag("cuisine")).alias("cuisine"),
        tag("shop").alias("shop_type"),
        F.coalesce("e.id", F.lit("")).alias("osm_id"),
        F.coalesce("e.type", F.lit("")).alias("osm_type"),
    )
    return shops.filter(F.col("name") != "").filter(X.keyword_match(F.col("name"), rules.SHOP_NAME_KEYWORDS) | X.keyword_match(F.col("cuisine"), rules.SHOP_CUISINE_KEYWORDS))


def standardize_sources(payloads: dict[str, DataFrame], config: dict[str, str], parsers: dict) -> DataFrame:
    """Each shop's payload by the parser of its configured strategy, all in one listing schema."""
    parts = [parsers[config[shop]](df).select(*LISTING) for shop, df in payloads.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
