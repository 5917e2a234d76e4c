"""Rule lists as data. Every function that uses one takes another in its place."""

from __future__ import annotations

# Brand rules, in order (part of a lower-cased name, brand).
BRANDS = [
    ("kikkoman", "Kikkoman"),
    ("pearl river bridge", "Pearl River Bridge"),
    ("lee kum kee", "Lee Kum Kee"),
    ("yamasa", "Yamasa"),
    ("abc", "ABC"),
]

# Variant rules, in order (LIKE patterns of a lower-cased name, variant), and the variant of all others.
VARIANTS = [
    (["%less salt%", "%gen_en%", "%reduced salt%"], "Reduced Salt"),
    (["%tamari%"], "Tamari"),
    (["%ponzu%"], "Ponzu"),
    (["%teriyaki%"], "Teriyaki"),
    (["%usukuchi%", "%light soy%"], "Light Soy Sauce"),
    (["%dark soy%"], "Dark Soy Sauce"),
    (["%sweet%", "%kecap manis%"], "Sweet Soy Sauce"),
]
DEFAULT_VARIANT = "Koikuchi Shoyu"

# Phrases that names use for the same thing, in order.
ALIASES = [
    ("healthy boy", "dek som boon"),
    ("shouyu", "shoyu"),
    ("sojasaus", "soy sauce"),
    ("gen'en", "reduced salt"),
    ("genen", "reduced salt"),
]

# Brands known to name comparison, and terms that tell a brand where no brand is named.
KNOWN_BRANDS = ["kikkoman", "yamasa", "abc", "pearl river bridge", "lee kum kee", "sempio", "marukin", "silver swan", "mee chun", "dek som boon", "kishibori", "tokusen"]
BRAND_HINTS = [("koikuchi shoyu", "kikkoman")]

# Terms of which one product can have one only.
EXCLUSIVE_PAIRS = [
    ("dark", "light"),
    ("sweet", "less salt"),
    ("sweet", "reduced salt"),
    ("sweet", "tamari"),
    ("sweet", "dark"),
    ("thin", "black"),
    ("tamari", "koikuchi"),
    ("usukuchi", "koikuchi"),
    ("usukuchi", "dark"),
    ("light", "koikuchi"),
    ("asin", "manis"),
    ("salty", "sweet"),
]

# Terms that both names must have, or neither.
QUALIFIERS = ["for rice", "for seafood", "gyoza", "nama", "ponzu", "tamari", "teriyaki", "sushi", "less salt", "reduced salt", "reduced sodium", "usukuchi", "double deluxe"]

# The match verdict's thresholds.
NAME_LEAST, IMAGE_LEAST, MATCH_BASE, MATCH_CONFIRMED, VOLUME_TOLERANCE = 0.3, 0.6, 0.8, 0.6, 0.05

# A lead score's weights by dimension, and its labels with inclusive bounds.
WEIGHTS = {"soy_engagement": 0.30, "cooking_frequency": 0.25, "brand_awareness": 0.20, "market_sentiment": 0.15, "cultural_affinity": 0.10}
LABELS = [(80, 100, "🔥 High propensity"), (60, 79, "✅ Medium-high"), (40, 59, "🟡 Medium"), (20, 39, "🔵 Low-medium"), (0, 19, "⬜ Low")]
EMPTY_CONVERSATION = "No conversation recorded."
NOT_MENTIONED = "Not mentioned"

# Keywords of shops worth keeping, by name and by cuisine.
SHOP_NAME_KEYWORDS = ["asia", "toko", "oriental", "japan", "china", "korean", "thai", "viet", "indo", "nikan", "shilla", "yong", "sushi", "ramen", "wok", "hing", "ming", "sing", "wing", "hong", "ping"]
SHOP_CUISINE_KEYWORDS = ["asian", "japanese", "chinese", "korean", "thai", "vietnamese", "indonesian", "sushi"]

# Keywords of products worth keeping.
SAUCE_KEYWORDS = ["shoyu", "soy sauce", "sojasaus"]

# Brands by keyword, and names that have no brand.
BRAND_KEYWORDS = [
    ("ABC", "abc"),
    ("DEK SOM BOON", "dek som boon"),
    ("HEALTHY BOY", "healthy boy"),
    ("HEALTHY BOY", "hb"),
    ("KIKKOMAN", "kikkoman"),
    ("LEE KUM KEE", "lee kum kee"),
    ("MARUKIN", "marukin"),
    ("MEE CHUN", "mee chun"),
    ("PEARL RIVER BRIDGE", "pearl river bridge"),
    ("SEMPIO", "sempio"),
    ("SILVER SWAN", "silver swan"),
    ("YAMASA", "yamasa"),
]
