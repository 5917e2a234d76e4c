import json

import pytest
from pyspark.sql import functions as F
from shelfline.functions import text as X
from shelfline.sources import listings as S
from shelfline.sources import tables as T
from shelfline.streaming import incremental as J


def test_listing_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("scrape_run_id,shop_name,product_name,raw_price,currency,product_url,scraped_at\n1,S,\"P, big\",,EUR,u,2024-01-01\n")
    row = S.read_listing_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.product_name, row.raw_price, row.image_url) == ("P, big", "", "")
    (tmp_path / "b.csv").write_text("shop_name\nS\n")
    with pytest.raises(ValueError):
        S.read_listing_csv(spark, str(tmp_path / "b.csv"))


def test_label_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text(" Shop Name 1 ,Verdict,extra\n a , ,x\n")
    df = S.read_label_csv(spark, str(tmp_path / "l.csv"), 2)
    assert df.columns == ["shop_name_1", "verdict"] and tuple(df.first()) == ("a", None)


def feed(spark, *payloads):
    return spark.createDataFrame([(i, "S", "https://s.example/", json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)], "feed_id long, shop_name string, base_url string, payload string")


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("feed_id", "product_name").collect()]


def test_feeds(spark):
    product = {"title": "Soy 500ml", "handle": "soy", "variants": [{"price": "4.50"}], "images": [{"src": "https://i/1"}]}
    assert rows(S.parse_product_feed(feed(spark, {"product": product}, {"product": product | {"variants": []}}, "junk"), "single")) == [("S", "Soy 500ml", "€4.50", "EUR", "https://s.example/products/soy", "https://i/1")]
    many = {"products": [product, product | {"handle": "second"}, {"title": "Rice 500ml", "variants": [{"price": "1"}]}]}
    assert len(rows(S.parse_product_feed(feed(spark, many), "list", lambda t: X.keyword_match(t, ["soy"]), ["500", "150"]))) == 1
    found = {"resources": {"results": {"products": [{"title": "Soy 150", "price": "3", "url": "/p", "featured_image": {"url": "https://i/2"}}, {"title": "Soy 500", "price": "", "url": "https://o/p", "featured_image": "https://i/3"}]}}}
    assert rows(S.parse_product_feed(feed(spark, found), "search")) == [("S", "Soy 150", "€3", "EUR", "https://s.example/p", "https://i/2"), ("S", "Soy 500", "", "EUR", "https://o/p", "https://i/3")]
    card = {"title": "Soy", "price": {"now": 2.5}, "images": [{"url": "https://i/4"}], "link": "/w"}
    assert rows(S.parse_product_feed(feed(spark, {"cards": [{"products": [card, card | {"link": "/x"}]}], "products": [{"title": "other"}]}), "cards")) == [("S", "Soy", "€2.50", "EUR", "https://s.example/w", "https://i/4")]
    assert rows(S.parse_product_feed(feed(spark, {"cards": [], "products": [card]}), "cards"))[0][1] == "Soy"


@pytest.mark.parametrize(
    "html, want",
    [
        ('<h1>A <b>x</b></h1><meta property="og:image" content="https://i"><meta content="3.5" itemprop="price">', ("A x", "€3.50", "EUR", "https://i")),
        ('<span class="woocommerce-Price-amount amount">€&nbsp;4,25</span><img src="https://s.example/a.png">', ("https://s.example/p", "€4.25", "EUR", "https://s.example/a.png")),
        ('<h1>B</h1><span id="Price1_inc">€ 9,98</span>', ("B", "€9.98", "EUR", "")),
        ('<h1>C</h1><span class="item-price">0,00</span><span class="item-price">€5,49</span>', ("C", "€5.49", "EUR", "")),
        ('<h1>D</h1><script type="application/ld+json">{"@type":"Product","name":"L","image":["https://j"],"offers":[{"lowPrice":"7","priceCurrency":"USD"}]}</script>', ("L", "€7.00", "USD", "https://j")),
        ('<h1>E</h1><script type="application/ld+json">[{"@type":"Thing"},{"@type":"Offer","price":8}]</script>', ("E", "€8.00", "EUR", "")),
        ("<h1>F</h1>no price", None),
    ],
)
def test_product_page(spark, html, want):
    found = S.extract_product_page(spark.createDataFrame([("https://s.example/p", html)], "url string, html string")).collect()
    assert [tuple(r)[1:] for r in found] == ([want] if want else [])


def test_links(spark):
    pages = spark.createDataFrame([(1, '<a href="/a">No</a><a class="x" href="/b"><i>Soy</i> one</a><a href="https://o/c">soy two</a>')], "page_id long, html string")
    found = S.find_listing_links(pages, lambda t: X.keyword_match(t, ["soy"]), F.lit("https://s"))
    assert [(r.pos, r.href) for r in found.orderBy("pos").collect()] == [(1, "https://s/b"), (2, "https://o/c")]
    prices = spark.createDataFrame([("https://o/c", "€1.00")], "url string, raw_price string")
    assert [r.href for r in S.first_priced_link(found, prices).collect()] == ["https://o/c"]


def test_map_elements(spark):
    doc = {"elements": [{"id": 1, "type": "node", "tags": {"name": " Toko X ", "url": "https://u", "addr:street": "S", "cuisine": "Thai"}}, {"id": 2, "tags": {"name": ""}}, {"id": 3, "tags": {"name": "Bakery"}}, {"id": 4}]}
    found = S.parse_osm_elements(spark.createDataFrame([(json.dumps(doc),)], "payload string")).collect()
    assert [(r.name, r.address, r.website, r.cuisine, r.osm_id) for r in found] == [("Toko X", "S", "https://u", "thai", "1")]


def test_standardize(spark):
    feed = spark.createDataFrame([(1, "One", "https://one/", json.dumps({"product": {"title": "A", "handle": "a", "variants": [{"price": "1.5"}]}}))], "feed_id int, shop_name string, base_url string, payload string")
    cards = spark.createDataFrame([(7, "Two", "https://two", json.dumps({"cards": [{"products": [{"title": "B", "price": {"now": 2}, "link": "/b"}, {"title": "B", "price": {"now": 3}}]}]}))], feed.schema)
    parsers = {"feed": lambda df: S.parse_product_feed(df, "single"), "cards": lambda df: S.parse_product_feed(df, "cards")}
    out = S.standardize_sources({"One": feed, "Two": cards}, {"One": "feed", "Two": "cards"}, parsers)
    assert out.columns == S.LISTING
    assert sorted(map(tuple, out.collect())) == [("One", "A", "€1.5", "EUR", "https://one/products/a", ""), ("Two", "B", "€2.00", "EUR", "https://two/b", "")]
    with pytest.raises(KeyError):
        S.standardize_sources({"One": feed}, {}, parsers)


def test_layers(spark):
    layers = T.Layers(schemas={"staging": "stage_x"}, overrides={"m": "table"})
    assert layers.schema_of("raw") == "default" and layers.schema_of("staging") == "stage_x"
    df = spark.range(3)
    assert layers.materialize(spark, "raw", "raw_view", df).count() == 3 and spark.table("raw_view").count() == 3
    assert layers.materialize(spark, "staging", "m", df).count() == 3


def test_refresh_policies(spark):
    df = spark.range(2)
    assert T.full_refresh(df, "refresh_t") and not T.full_refresh(df.limit(0), "refresh_t")
    assert spark.table("refresh_t").count() == 2
    assert T.full_refresh(df.limit(0), "refresh_t", "truncate") and spark.table("refresh_t").count() == 0


def test_upsert(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string, at int")
    first = J.incremental_upsert(make((1, "a", 1), (2, "b", 1)), None, ["k"], F.col("at"))
    second = J.incremental_upsert(make((2, "c", 2), (3, "late", 1)), first, ["k"], F.col("at"))
    assert sorted(map(tuple, second.collect())) == [(1, "a", 1), (2, "c", 2)]
    assert sorted(map(tuple, J.incremental_upsert(make((2, "c", 2)), second, ["k"], F.col("at")).collect())) == [(1, "a", 1), (2, "c", 2)]
    assert J.incremental_upsert(make((1, "x", 9)), first.limit(0), ["k"], F.col("at")).count() == 0
    twice = make((5, "x", 3), (5, "y", 4))
    with pytest.raises(ValueError):
        J.incremental_upsert(twice, first, ["k"], F.col("at"))
    assert J.incremental_upsert(twice, first, ["k"], F.col("at"), "last", ["at"]).filter("k = 5").first().v == "y"
