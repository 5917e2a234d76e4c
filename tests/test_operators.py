import random

from pyspark.sql import functions as F
from shelfline.llm import common as C
from shelfline.llm import shingles
from shelfline.operators import graph, marts
from shelfline.operators import relational as R
from shelfline.operators import warehouse as WH


def roots(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    return {r.node: r.root for r in graph.connected_components(df, "a", "b").collect()}


def test_components(spark):
    assert roots(spark, [("b", "c"), ("a", "b"), ("x", "y")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert roots(spark, []) == {}
    assert roots(spark, [("z", "z"), (None, "a")]) == {"z": "z"}


def test_components_at_random(spark):
    rng = random.Random(3)
    edges = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(180)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(60)]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for x in list(parent)}
    assert roots(spark, edges) == want
    rng.shuffle(edges)
    assert roots(spark, [(b, a) for a, b in edges]) == want


def test_components_alike_at_every_size(spark):
    rng = random.Random(5)
    for edges, kind in ([[(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)], "long"], [[(f"n{i}\u00e9", f"n{i + 1}\u00e9") for i in range(200)] + [("z", "z"), ("Z", None)], "string"]):
        df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
        few, many = (sorted(map(tuple, graph.connected_components(df, "a", "b", small=n).collect())) for n in (graph.SMALL, 0))
        assert few == many and len(few) == len({x for e in edges if None not in e for x in e})


def jobs_of(spark, work):
    """How many jobs work() starts."""
    ran = spark.sparkContext._jsc.sc().dagScheduler
    before = ran().nextJobId()
    work()
    return ran().nextJobId() - before


def test_few_edges_need_no_rounds(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    assert jobs_of(spark, lambda: graph.connected_components(path, "a", "b").collect()) <= 5


def test_sketch_comes_by_jobs_that_no_partition_adds_to(spark):
    texts = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> cast(xxhash64(id, i) AS string))) AS text")
    told = C.staged(shingles.signatures(texts, 5, "doc_id", "text"), "signatures")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        counts = []
        assert jobs_of(spark, lambda: counts.append(shingles.column_counts(told))) <= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counts[0].sum() == 200 * 36


def test_one_latest_version(spark):
    rows = [("p", f"u{i % 3}", f"i{i % 2}", f"2024-01-0{i + 1}") for i in range(6)]
    df = spark.createDataFrame(rows, "product_id string, product_url string, image_url string, scraped_at string").select("*", *(F.lit("x").alias(c) for c in WH.ATTRIBUTES if c not in ("product_id", "product_url", "product_image_url")))
    history, dim = WH.scd2_build(df)
    assert history.filter("is_latest").count() == 1 and dim.count() == 1
    assert history.filter("is_latest").first().valid_to.isoformat() == "2024-01-06"


def test_unordered_labels(spark):
    cols = "s1 string, n1 string, s2 string, n2 string"
    scores = spark.createDataFrame([("A", "x", "B", "y"), ("A", "x", None, "y")], cols)
    labels = spark.createDataFrame([(" b ", "Y", "a", "X", "SAME", "same"), ("a", "x", "c", "z", "SAME", "DIFFERENT")], cols + ", verdict string, manual_check string")
    got = R.join_unordered_pairs(scores, labels, ["s1", "n1"], ["s2", "n2"]).collect()
    assert sorted((r.s2 or "", r.ground_truth_verdict) for r in got) == [("", None), ("B", "SAME")]
    twice = labels.unionByName(labels.select(F.col("s2").alias("s1"), F.col("n2").alias("n1"), F.col("s1").alias("s2"), F.col("n1").alias("n2"), "verdict", "manual_check"))
    assert R.dedup_labels(twice, ["s1", "n1"], ["s2", "n2"], ["s1"]).count() == 2


def test_metrics_without_labels(spark):
    df = spark.createDataFrame([(1, True, None)], "computed_at int, is_match boolean, ground_truth_verdict string")
    counts = marts.confusion_counts(df)
    assert marts.match_metrics(counts).first().f1 is None
    assert marts.match_metrics(counts, "zero").first().f1 == 0.0


def test_scorecards_of_nothing(spark):
    empty = spark.createDataFrame([], "global_product_id string, shop_name string, scrape_month date, avg_price_eur double, min_price_eur double, max_price_eur double, shop_count long")
    row = marts.scorecards(empty).first()
    assert (row.avg_price, row.products, row.shops, row.last_updated) == (0.0, 0, 0, "—")


def test_histogram_keeps_all_when_few_are_left(spark):
    px = spark.createDataFrame([("a", 10, 10, 10)] * 50 + [("a", 100, 100, 100)] * 10 + [("b", 100, 0, 8)] * 120, "image_id string, r int, g int, b int")
    got = {r.image_id: r.histogram for r in marts.color_histogram(px).collect()}
    assert len(got["a"]) == 96 and abs(sum(got["a"]) - 1) < 1e-6
    assert abs(got["a"][1] - 50 / 180) < 1e-6 and abs(got["b"][100 // 8] - 1 / 3) < 1e-6
