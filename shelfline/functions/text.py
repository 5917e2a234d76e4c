"""Column functions over names, prices, sizes and addresses. All of them stay in the JVM; null gives null unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import rules


def non_blank(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def keyword_match(c: Column, *groups: list[str]) -> Column:
    """Any keyword of each group, as part of the lower-cased text."""
    low = F.lower(c)
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(k) for k in g]) for g in groups])


def valid_email(c: Column) -> Column:
    """One @, no blanks, and a dot within the domain."""
    return F.trim(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def parse_price(raw: Column) -> Column:
    """Price text to a double: currency marks and blanks go, a comma is a point; null if what is left isn't a plain number."""
    bare = raw
    for mark in ("€", "EUR", " "):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    # What other white space stands around the number goes; within it, it makes the text no number.
    bare = F.regexp_replace(F.replace(bare, F.lit(","), F.lit(".")), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def strip_query(url: Column) -> Column:
    """The address before its first question mark."""
    return F.substring_index(url, "?", 1)


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group at its first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


#: The patterns of sizes in names, which differ on purpose, as each reader of names has its own.
ML_LOOSE, LITRES_LOOSE = r"(\d+)\s*[Mm][Ll]", r"(\d+(?:\.\d+)?)\s*[Ll]"
BLOCK_LITRES = ("([0-9]+)[ ]*(?:liter|litre)", "([0-9]+)[ ]*l[^a-z]", "([0-9]+)[ ]*l$")
BLOCK_SIZE = "([0-9]+[ ]*(?:ml|kg|g))"
STRICT_SIZE = r"(\d+(?:[.,]\d+)?)\s*(l|ml)\b"


def volume_ml_default(name: Column, default: int = 500) -> Column:
    """Millilitres before `ml`; else litres before `l`, rounded; else the default. Loose: a unit may begin a longer word."""
    ml, litres = _first(name, ML_LOOSE).try_cast("long"), _first(name, LITRES_LOOSE).try_cast("double")
    return F.when(name.rlike(ML_LOOSE), ml).when(name.rlike(LITRES_LOOSE), F.floor(litres * 1000 + 0.5)).otherwise(F.lit(default).cast("long"))


def volume_block_key(name: Column) -> Column:
    """A size as text for blocking: litres become `<n>000ml`, else the first `<n>ml`, `<n>kg` or `<n>g`; whole digits only."""
    low = F.lower(name)
    litre = F.coalesce(*(_first(low, p).try_cast("long") for p in BLOCK_LITRES))
    return F.when(litre.isNotNull(), F.concat((litre * 1000).cast("string"), F.lit("ml"))).otherwise(F.replace(_first(low, BLOCK_SIZE), F.lit(" "), F.lit("")))


def volume_ml_strict(name: Column) -> Column:
    """Millilitres of the first number with unit `l` or `ml`, a decimal comma allowed; null if there is none."""
    low = F.lower(name)
    value = F.replace(_first(low, STRICT_SIZE), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(_first(low, STRICT_SIZE, 2) == "l", value * 1000).otherwise(value)


def classify_brand(name: Column, brands: list[tuple[str, str]] = rules.BRANDS, other: str = "Other") -> Column:
    """The first brand whose mark is part of the lower-cased name."""
    low, out = F.lower(name), F.lit(other)
    for mark, brand in reversed(brands):
        out = F.when(low.contains(mark), brand).otherwise(out)
    return out


def classify_variant(name: Column, variants: list[tuple[list[str], str]] = rules.VARIANTS, other: str = rules.DEFAULT_VARIANT) -> Column:
    """The first variant one of whose LIKE patterns the lower-cased name has."""
    low, out = F.lower(name), F.lit(other)
    for patterns, variant in reversed(variants):
        out = F.when(reduce(lambda a, b: a | b, [low.like(p) for p in patterns]), variant).otherwise(out)
    return out


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: the same in every engine that has doubles."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def safe_ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, null where b is nought, rounded if asked."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if digits is None else round_half_up(q, digits)


def price_per_100ml(price: Column, volume: Column, digits: int = 4) -> Column:
    return safe_ratio(price * 100, volume, digits)


def normalize_name(name: Column, aliases: list[tuple[str, str]] = rules.ALIASES) -> Column:
    """Lower case, then each alias by its canonical form, in order."""
    return reduce(lambda c, a: F.replace(c, F.lit(a[0]), F.lit(a[1])), aliases, F.lower(name))


def strip_phrases(c: Column, phrases: list[str] = rules.KNOWN_BRANDS) -> Column:
    """Each phrase to a blank, the longest first."""
    return reduce(lambda c, p: F.replace(c, F.lit(p), F.lit(" ")), sorted(phrases, key=len, reverse=True), c)


def tokenize_name(name: Column, aliases: list[tuple[str, str]] = rules.ALIASES, phrases: list[str] = rules.KNOWN_BRANDS) -> Column:
    """Distinct tokens of a name without brands; a number and its unit are one token."""
    bare = F.regexp_replace(strip_phrases(normalize_name(name, aliases), phrases), r"(\d+)\s+(ml|l|kg|g)\b", "$1$2")
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(bare, "[^a-z0-9]", " "), " +"), ""))


def jaccard(a: Column, b: Column, digits: int = 4) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(round_half_up(share, digits))


def detect_brands(name: Column, brands: list[str] = rules.KNOWN_BRANDS, hints: list[tuple[str, str]] = rules.BRAND_HINTS, aliases: list[tuple[str, str]] = rules.ALIASES) -> Column:
    """Known brands that a name has; hints tell only where no brand is named."""
    n = normalize_name(name, aliases)
    found = F.array_compact(F.array(*(F.when(n.contains(b), F.lit(b)) for b in brands)))
    told = F.array_distinct(F.array_compact(F.array(*(F.when(n.contains(t), F.lit(b)) for t, b in hints)))) if hints else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(told)


def clean_image_url(c: Column) -> Column:
    """A plain address as it is; of a dictionary's text its url, contentUrl or image; else empty."""
    d = F.from_json(c, "url string, contentUrl string, image string", {"allowSingleQuotes": "true"})
    return F.when(c.isNull() | (c == ""), "").when(c.startswith("http"), c).otherwise(F.coalesce(F.nullif(d["url"], F.lit("")), F.nullif(d["contentUrl"], F.lit("")), d["image"], F.lit("")))


def shown_text(c: Column, kind: str) -> Column:
    """A value as a page shows it: whole numbers without a point, null as the word."""
    text = c.cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.0$", "") if kind in ("double", "float") else text, F.lit("null"))


def collation_order(c: Column, collations: tuple[str, ...] = ("UNICODE_CI_AI", "UNICODE_CI", "UNICODE")) -> list[Column]:
    """Columns whose order is that of texts by the Unicode collation, with runs of digits as numbers: letters first, then
    their accents, then their case (small before capital), each over the whole text. Others of Spark's collations, such as those of
    a language, can be named, one for each level."""
    runs = F.regexp_extract_all(c, F.lit("([^0-9]*[0-9]+|[^0-9]+)"), F.lit(0))

    def level(collation: str) -> Column:
        def part(p: Column) -> Column:
            # A run of digits stands as one digit, so that what comes before it is compared as if its first digit followed.
            text, digits = F.regexp_replace(p, "[0-9]+$", "0"), F.regexp_replace(F.regexp_extract(p, "[0-9]*$", 0), "^0+(?=.)", "")
            return F.struct(F.collate(text, collation).alias("text"), F.length(digits).alias("size"), digits.alias("digits"))

        return F.transform(runs, part)

    return [level(x) for x in collations]


#: What a short label drops, in order (pattern, by), and its length.
SHORTENED = [(r"(?i)^(\S+)\s+\1\s+", "$1 "), (r"(?i)^(.{4,25}?)\s+\1\s+", "$1 "), (r"(?i)\bNaturally Brewed\b", ""), (r"\s{2,}", " ")]
LABEL = 40


def short_name(name: Column, most: int = LABEL) -> Column:
    """A label: entities read, doubled beginnings once, filler out, blanks squeezed, long ones cut with an ellipsis."""
    s = F.replace(name, F.lit("&amp;"), F.lit("&"))
    for pattern, by in SHORTENED:
        s = F.regexp_replace(s, pattern, by)
        s = F.trim(s) if "1" not in by else s
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 2)), F.lit("…"))).otherwise(s)


def format_size(ml: Column) -> Column:
    """150ml, 1L, 1.8L."""
    whole = (ml >= 1000) & (ml % 1000 == 0)
    return F.when(whole, F.concat((ml / 1000).cast("long").cast("string"), F.lit("L"))).when(ml >= 1000, F.concat(F.format_string("%.1f", round_half_up(ml / 1000.0, 1)), F.lit("L"))).otherwise(F.concat(ml.cast("string"), F.lit("ml")))


def heat_bucket(value: Column, least: Column, most: Column) -> Column:
    """flat if all values are equal, else low, mid, high or top by quarter of the range."""
    t = safe_ratio(value - least, most - least)
    return F.when(least == most, "flat").when(t < 0.25, "low").when(t < 0.5, "mid").when(t < 0.75, "high").otherwise("top")


def url_host(url: Column) -> Column:
    """Host of an address; empty if it is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def url_origin(url: Column) -> Column:
    """Scheme and host of an address; empty if it is none."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.concat(scheme, F.lit("://"), host), F.lit(""))


def format_eur(c: Column, style: str = "plain") -> Column:
    """€1234.50; or in the German way 1.234,50 €."""
    if style == "plain":
        return F.format_string("€%.2f", round_half_up(c, 2))
    return F.concat(F.translate(F.format_number(round_half_up(c, 2), 2), ",.", ".,"), F.lit("\u00a0€"))


def prefer_existing(a: Column, b: Column) -> Column:
    """a unless it is null or empty, then b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


#: Fixed value: what stands for null in a surrogate key.
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*cols: Column, sentinel: str = NULL_KEY) -> Column:
    """md5 of the columns' texts joined by a dash, null by a fixed sentinel."""
    return F.md5(F.concat_ws("-", *(F.coalesce(c.cast("string"), F.lit(sentinel)) for c in cols)).cast("binary"))


#: Fixed value: the name space of product ids, RFC 4122's name space of domain names.
ID_SPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(text: Column, space: str = ID_SPACE) -> Column:
    """Version 5 UUID of a text within a name space (RFC 4122): its SHA-1 with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def node_key(shop: Column, name: Column, sep: str = "||") -> Column:
    return F.concat(shop, F.lit(sep), name)


def split_node(node: Column, sep: str = "||") -> Column:
    """struct(shop, name), split at the first separator."""
    at = F.instr(node, sep)
    return F.struct(F.substring(node, F.lit(1), at - 1).alias("shop"), F.substring(node, at + len(sep), F.length(node)).alias("name"))


def month_of(c: Column) -> Column:
    """First day of the month, a date."""
    return F.trunc(c.cast("date"), "MM")


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def date_of(ts: Column) -> Column:
    return F.to_date(ts)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def local_time(ts: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Wall clock time of a zone, without a zone."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")
