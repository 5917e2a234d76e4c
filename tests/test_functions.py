import json
import uuid

import pytest
from pyspark.sql import functions as F
from shelfline.functions import leads as L
from shelfline.functions import matching as M
from shelfline.functions import rules
from shelfline.functions import text as X

from tests.helpers import one


@pytest.mark.parametrize("raw, want", [("€ 9,98", 9.98), ("EUR 4.5", 4.5), ("1.234,56", None), ("", None), ("nan", None), ("1.0d", None), ("12", 12.0)])
def test_parse_price(spark, raw, want):
    assert one(spark, X.parse_price(F.col("r")), r=raw) == want


@pytest.mark.parametrize("url, want", [("https://a/p?x=1?y", "https://a/p"), ("https://a/p", "https://a/p")])
def test_strip_query(spark, url, want):
    assert one(spark, X.strip_query(F.col("u")), u=url) == want


@pytest.mark.parametrize("name, default, key, strict", [("500ml", 500, "500ml", 500.0), ("150 ML", 150, "150ml", 150.0), ("1L", 1000, "1000ml", 1000.0), ("1.5L", 1500, "5000ml", 1500.0), ("none", 500, None, None), ("1,5L", 5000, "5000ml", 1500.0), ("SOY SAUCE 1 LITER", 1000, "1000ml", None), ("970g", 500, "970g", None), ("700 gyoza", 500, "700g", None), ("1,5 l", 5000, "5000ml", 1500.0)])
def test_volumes(spark, name, default, key, strict):
    n = F.col("n")
    assert one(spark, F.array(X.volume_ml_default(n).cast("string"), X.volume_block_key(n), X.volume_ml_strict(n).cast("string")), n=name) == [str(default), key, None if strict is None else str(strict)]


def test_brands_and_variants(spark):
    assert one(spark, X.classify_brand(F.lit("Lee Kum Kee Premium"))) == "Lee Kum Kee"
    assert one(spark, X.classify_brand(F.lit("No name"))) == "Other"
    assert one(spark, X.classify_variant(F.lit("Gen'en shoyu"))) == "Reduced Salt"
    assert one(spark, X.classify_variant(F.lit("Soy sauce"))) == rules.DEFAULT_VARIANT
    assert one(spark, X.detect_brands(F.lit("Yamasa Koikuchi Shoyu"))) == ["yamasa"]
    assert one(spark, X.detect_brands(F.lit("Koikuchi Shoyu 150ML TD"))) == ["kikkoman"]
    assert one(spark, X.detect_brands(F.lit("Healthy Boy thin"))) == ["dek som boon"]


def test_name_similarity(spark):
    def sim(a, b):
        return one(spark, X.jaccard(X.tokenize_name(F.lit(a)), X.tokenize_name(F.lit(b))))

    assert sim("Thin Soy Sauce (Healthy Boy) 700ml", "Dek Som Boon Dek Som Boon Thin Soy Sauce, 700ml") == 1.0
    assert sim("Thin sauce 250 ml", "thin sauce 250ml") == 1.0
    assert sim("", "thin") == 0.0


def test_gates(spark):
    assert one(spark, M.exclusive_conflict(F.lit("Dark soy"), F.lit("Light soy")))
    assert not one(spark, M.exclusive_conflict(F.lit("Dark soy"), F.lit("Soy")))
    assert one(spark, M.qualifier_mismatch(F.lit("Tamari"), F.lit("Soy")))
    both = lambda a, b: tuple(one(spark, f(F.lit(a).cast("double"), F.lit(b).cast("double"))) for f in (M.volume_mismatch, M.same_volume))
    assert both(150, 1000) == (True, False) and both(1000, 975) == (False, True) and both(None, 100) == (False, False)


@pytest.mark.parametrize("image, name, same, want", [(0.73, 0.3, True, True), (0.79, 0.5, False, False), (0.8, 0.5, False, True), (0.59, 0.5, True, False), (0.9, 0.29, True, False)])
def test_verdict(spark, image, name, same, want):
    threshold = M.match_threshold(F.lit(same), F.lit(same))
    assert one(spark, M.match_verdict(F.lit(image), F.lit(name), [F.lit(False)], threshold)) is want
    assert not one(spark, M.match_verdict(F.lit(0.99), F.lit(0.99), [F.lit(True)], threshold))


def test_vectors_and_pixels(spark):
    assert one(spark, M.geo_mean_score(F.lit(0.89), F.lit(0.40))) == 0.5967
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, M.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(0.5**0.5)
    assert one(spark, M.cosine(v(1.0, 0.0), v(-1.0, 0.0))) == 0.0
    assert one(spark, F.array(*M.whiten_dark(F.lit(10), F.lit(20), F.lit(59)))) == [255, 255, 255]
    assert one(spark, F.array(*M.whiten_dark(F.lit(10), F.lit(20), F.lit(60)))) == [10, 20, 60]


@pytest.mark.parametrize("name, want", [("Yamasa Yamasa Soy Sauce, 150ml", "Yamasa Soy Sauce, 150ml"), ("Lee Kum Kee Lee Kum Kee Soy", "Lee Kum Kee Soy"), ("A &amp; B Naturally Brewed  sauce", "A & B sauce"), ("x" * 41, "x" * 38 + "…")])
def test_short_name(spark, name, want):
    assert one(spark, X.short_name(F.lit(name))) == want


def test_formats(spark):
    assert [one(spark, X.format_size(F.lit(n))) for n in (150, 1000, 1800)] == ["150ml", "1L", "1.8L"]
    assert one(spark, X.format_eur(F.lit(1234.5))) == "€1234.50"
    assert one(spark, X.format_eur(F.lit(1234.5), "german")) == "1.234,50\u00a0€"
    assert one(spark, X.url_origin(F.lit("https://a.example/p?x"))) == "https://a.example"
    assert one(spark, X.url_host(F.lit("not an address"))) == ""
    assert one(spark, X.heat_bucket(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == "flat"
    assert [one(spark, X.heat_bucket(F.lit(x), F.lit(0.0), F.lit(4.0))) for x in (0.0, 1.0, 2.0, 3.0)] == ["low", "mid", "high", "top"]
    assert one(spark, X.valid_email(F.lit(" a@b.c "))) and not one(spark, X.valid_email(F.lit("a@b")))
    assert one(spark, X.clean_image_url(F.lit("{'@type': 'ImageObject', 'url': '', 'contentUrl': 'https://i'}"))) == "https://i"
    assert [one(spark, X.clean_image_url(F.lit(x))) for x in ("", "http://x", "junk")] == ["", "http://x", ""]


@pytest.mark.parametrize("text", ["Dun Yong||Soy 500ml", "", "été 🙂"])
def test_uuid5(spark, text):
    assert one(spark, X.uuid5(F.lit(text))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, text))


def test_keys(spark):
    assert one(spark, X.uuid5(X.node_key(F.lit("Dun Yong"), F.lit("Soy 500ml")))) == "179aab73-7d81-5927-b9b3-3e0a8c8c1768"
    assert tuple(one(spark, X.split_node(F.lit("a||b||c")))) == ("a", "b||c")
    assert one(spark, X.surrogate_key(F.lit("a"), F.lit(None))) != one(spark, X.surrogate_key(F.lit("a"), F.lit("")))


def test_scores(spark):
    m = lambda n: F.create_map(*(x for k in rules.WEIGHTS for x in (F.lit(k), F.lit(n))))
    assert one(spark, L.propensity_score(m(5))) == 100.0
    assert one(spark, L.propensity_score(m(2))) == 25.0
    assert one(spark, L.propensity_label(F.lit(25.0))).endswith("Low-medium")
    assert one(spark, L.propensity_label(F.lit(79.5))) == "Unknown"


def test_json(spark):
    obj = lambda t: one(spark, L.first_json_object(F.lit(t), "a int")["a"])
    assert [obj(t) for t in ('x {"a": 1} y', '```json\n{"a": 2}\n```', "none", "{bad")] == [1, 2, None, None]


def test_histories(spark):
    turns = F.from_json(F.lit(json.dumps([{"role": "user", "text": "hi"}, {"role": "assistant", "text": "x"}, {"role": "user", "text": "soy"}])), L.TURNS)
    assert one(spark, L.prompt_text(turns)) == "User message 1: hi\nUser message 2: soy"
    assert one(spark, L.prompt_text(F.array().cast(L.TURNS))) == rules.EMPTY_CONVERSATION
    made = lambda conv, reason, brand: [t["text"] for t in one(spark, L.fallback_history(F.lit(conv).cast("string"), F.lit(reason).cast("string"), [(F.lit(brand).cast("string"), "Mine is ", ".")], "Hello."))]
    assert made('[{"role":"user","text":"q"}]', "a", "b") == ["q"]
    assert made("not json", "a / b /  ", "K") == ["a", "b", "Mine is K."]
    assert made(None, None, "Not mentioned") == ["Hello."]
