"""Column functions that decide whether two listings are one product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions import rules
from shelfline.functions.text import round_half_up


def same_brand(a: Column, b: Column) -> Column:
    """Brand sets that share a brand."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def brand_conflict(a: Column, b: Column) -> Column:
    """Both sets hold brands, and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~same_brand(a, b)


def exclusive_conflict(a: Column, b: Column, pairs: list[tuple[str, str]] = rules.EXCLUSIVE_PAIRS) -> Column:
    """One lower-cased name has a pair's one term, the other the other."""
    x, y = F.lower(a), F.lower(b)
    return reduce(lambda p, q: p | q, [(x.contains(s) & y.contains(t)) | (x.contains(t) & y.contains(s)) for s, t in pairs])


def qualifier_mismatch(a: Column, b: Column, terms: list[str] = rules.QUALIFIERS) -> Column:
    """A term is in one lower-cased name only."""
    x, y = F.lower(a), F.lower(b)
    return reduce(lambda p, q: p | q, [x.contains(t) != y.contains(t) for t in terms])


def _apart(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def volume_mismatch(a: Column, b: Column, tolerance: float = rules.VOLUME_TOLERANCE) -> Column:
    """Both volumes are known and differ by more than the tolerance."""
    return F.coalesce(_apart(a, b) > tolerance, F.lit(False))


def same_volume(a: Column, b: Column, tolerance: float = rules.VOLUME_TOLERANCE) -> Column:
    """Both volumes are known and within the tolerance."""
    return F.coalesce(_apart(a, b) <= tolerance, F.lit(False))


def match_threshold(brand_same: Column, volume_same: Column, confirmed: float = rules.MATCH_CONFIRMED, base: float = rules.MATCH_BASE) -> Column:
    return F.when(brand_same & volume_same, confirmed).otherwise(base)


def match_verdict(image: Column, name: Column, gates: list[Column], threshold: Column, name_least: float = rules.NAME_LEAST, image_least: float = rules.IMAGE_LEAST) -> Column:
    """No gate holds, both scores reach their least, and the image score its threshold."""
    stopped = reduce(lambda a, b: a | b, [*gates, name < name_least, image < image_least])
    return ~stopped & (image >= threshold)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, within 0 and 1. Where one vector meets many, scale each once with unit() and take dot()."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))))


def geo_mean_score(cos: Column, color: Column, digits: int = 4) -> Column:
    """Geometric mean of two scores, within 0 and 1."""
    return round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), cos) * F.greatest(F.lit(0.0), color)))), digits)


def whiten_dark(r: Column, g: Column, b: Column, below: int = 60) -> list[Column]:
    """r, g and b of a pixel, white if all are dark."""
    dark = (r < below) & (g < below) & (b < below)
    return [F.when(dark, 255).otherwise(c) for c in (r, g, b)]
