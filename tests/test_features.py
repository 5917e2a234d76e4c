"""Fused checks, rejects, collation, lists in chunks, generations of a table, trends by product."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from shelfline.functions import text as X
from shelfline.operators import marts
from shelfline.operators import quality as Q
from shelfline.operators import relational as R
from shelfline.sources import listings as S
from shelfline.sources import rejects
from shelfline.sources import tables


def checks():
    return [Q.is_not_null("a"), Q.is_unique("a"), Q.are_unique(["a", "b"]), Q.is_accepted("b", ["x", "y"]), Q.is_between("c", 1, 3), Q.are_unique(["b"])]


def test_fused_checks_are_the_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "x", "y", "z", "x, y"]), rng.choice([None, 0.5, 1.0, 3.0, 3.5])) for _ in range(40)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    twice = lambda keys: sum(n > 1 for n in Counter(keys).values())
    want = {
        "not_null_a": sum(r[0] is None for r in rows),
        "unique_a": twice(r[0] for r in rows if r[0] is not None),
        "unique_combination_a_b": twice((r[0], r[1]) for r in rows),
        "accepted_values_b": sum(r[1] is not None and r[1] not in "xy" for r in rows),
        "accepted_range_c": sum(r[2] is not None and not 1 <= r[2] <= 3 for r in rows),
        "unique_combination_b": twice(r[1] for r in rows),
    }
    assert {r.check_name: r.failures for r in Q.fused(df, checks()).collect()} == want
    assert {r.check_name: r.failures for r in Q.fused(df.limit(0), checks()).collect()} == dict.fromkeys(want, 0)
    only_rows = [c for c in checks() if c.failed is not None]
    assert {r.check_name: r.failures for r in Q.fused(df, only_rows).collect()} == {c.name: want[c.name] for c in only_rows}
    seen, told = Q.watched(df, only_rows)
    seen.collect()
    assert told.get == {c.name: want[c.name] for c in only_rows}
    with pytest.raises(ValueError):
        Q.watched(df, checks())


def test_fused_checks_read_a_table_once(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("a"), F.lit("x").alias("b"), F.lit(1.0).alias("c")).write.parquet(f"{tmp_path}/t")
    plan = Q.fused(spark.read.parquet(f"{tmp_path}/t"), checks())._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == 1 and plan.count("hashpartitioning") <= 2
    df = spark.read.parquet(f"{tmp_path}/t")
    got = Q.run_checks([("m", df, checks()[:1]), ("n", df, checks()[1:2])]).collect()
    assert sorted((r.model, r.check_name, r.failures, r.status) for r in got) == [("m", "not_null_a", 0, "pass"), ("n", "unique_a", 0, "pass")]


def test_feed_rejects(spark):
    ok = {"title": "A", "variants": [{"price": "1"}]}
    rows = [(1, json.dumps({"products": [ok, {"title": "B", "variants": []}, {"title": "C"}, ok]})), (2, "{"), (3, None), (4, ""), (5, "{}"), (6, '{"products": []}'), (7, "[1, 2]"), (7, json.dumps({"products": [ok]}))]
    feeds = spark.createDataFrame(rows, "feed_id int, payload string").select("*", F.lit("s").alias("shop_name"), F.lit("https://s/").alias("base_url"))
    bad = rejects.feed_rejects(feeds, "list").collect()
    assert sorted((r.feed_id, -1 if r.pos is None else r.pos, r.reason) for r in bad) == [(1, 1, "no variants"), (1, 2, "no variants"), (2, -1, "malformed JSON"), (3, -1, "empty payload"), (4, -1, "empty payload"), (5, -1, "no products"), (6, -1, "no products"), (7, -1, "malformed JSON")]
    assert S.parse_product_feed(feeds, "list").count() == 3
    assert json.loads(next(r for r in bad if r.feed_id == 1 and r.pos == 1).rejected)["title"] == "B" and next(r for r in bad if r.feed_id == 2).rejected == "{"
    single = spark.createDataFrame([(1, json.dumps({"product": ok})), (2, json.dumps({"product": {"title": "x"}})), (3, "{}")], "feed_id int, payload string")
    assert sorted((r.feed_id, r.reason) for r in rejects.feed_rejects(single, "single").collect()) == [(2, "no variants"), (3, "no products")]
    for kind in S.FEEDS:
        assert rejects.feed_rejects(feeds.limit(0), kind).count() == 0


def test_order_by_the_collation(spark):
    want = ["  lead", "_x", "-1", "9", "10", "a b", "a1", "a9", "a10", "ab", "e", "É", "eclair 2", "Eclair 2", "éclair 2", "eclair 10", "f", None, "o", "Ö", "ss", "z", "Zebra 2", "zebra 10"]
    mixed = want[:]
    random.Random(2).shuffle(mixed)
    df = spark.createDataFrame([("Yes", w) for w in mixed] + [("no", "a")], "kept string, w string")
    assert [r.w for r in R.search_and_sort(df, "YES", "kept", "w").collect()] == want
    assert [r.w for r in R.search_and_sort(df, "yes", "kept", "w", False).collect()] == want[::-1]
    assert {r.w: r.place for r in R.search_and_rank(df, "yes", "kept", "w").collect()} == {w: n for n, w in enumerate(want, 1)}
    numbers = spark.createDataFrame([(x,) for x in (10.0, 9.5, 1.25, 1.5, 100.0, None)], "x double").withColumn("t", F.lit("t"))
    assert [r.x for r in R.search_and_sort(numbers, "t", "t", "x").collect()] == [1.5, 1.25, 9.5, 10.0, 100.0, None]  # as texts: 5 before 25


def test_prices_with_blanks(spark):
    cases = {" € 9,98 ": 9.98, "\t4.5 \n": 4.5, "1 234,5": None, "€1 234,5": 1234.5, "nan": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.p for r in df.select("t", X.parse_price(F.col("t")).alias("p")).collect()} == cases


def test_a_large_component_is_many_lists(spark):
    nodes = spark.range(100_000).select(F.lit("r").alias("root"), F.format_string("%07d", "id").alias("node")).unionByName(spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "c"), ("b", "c")], "root string, node string"))
    got = marts.component_listing(nodes, 7000).collect()
    assert all(len(r.members) <= 7000 for r in got) and {(r.root, r["size"]) for r in got} == {("r", 100_000), ("b", 2)}
    members = [m for r in sorted(got, key=lambda r: r.chunk) if r.root == "r" for m in r.members]
    assert members == sorted(members) and len(members) == 100_000
    assert [(r.chunk, r.members) for r in got if r.root == "b"] == [(0, ["b", "c"])]


def test_summaries_and_chunks_are_the_rollup(spark):
    rows = [(c, t, ["user", "assistant", "system"][(t * 7 + c) % 3], f'say "{t}"\n') for c in (1, 2) for t in range(10)] + [(3, 0, "assistant", "alone"), (None, 1, "user", "of none")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    whole = {r.conv_id: r for r in marts.conversation_rollup(df).collect()}
    short = {r.conv_id: r for r in marts.conversation_summary(df).collect()}
    assert {k: (r.reason, r.ai_reply, r.turns) for k, r in short.items()} == {k: (r.reason, r.ai_reply, len(r.history)) for k, r in whole.items()}
    assert {r.conv_id: r.history for r in marts.history_chunks(df).collect()} == {k: r.conversation_json for k, r in whole.items()}
    parts = sorted(((r.conv_id or 0, r.chunk, json.loads(r.history)) for r in marts.history_chunks(df, chunk=4).collect()), key=lambda r: r[:2])
    assert [t for c, _, h in parts if c == 1 for t in h] == json.loads(whole[1].conversation_json) and max(len(h) for *_, h in parts) == 4


def test_generations(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(Exception):
        tables.read_generations(spark, path)
    tables.append_generation(spark.createDataFrame([(1, 1.5)], "k int, x float"), path, "a")
    tables.append_generation(spark.createDataFrame([(2**40, 2.5, "v")], "K long, x double, v string"), path, "b")
    tables.append_generation(spark.createDataFrame([(True,)], "flag boolean"), path, "c")
    with pytest.raises(Exception):
        tables.append_generation(spark.range(1), path, "c")
    got = tables.read_generations(spark, path)
    assert got.dtypes == [("k", "bigint"), ("x", "double"), ("v", "string"), ("flag", "boolean"), ("generation", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1.5, None, None, "a"), (2**40, 2.5, "v", None, "b"), (None, None, None, True, "c")]
    with pytest.raises(ValueError):
        tables.widened([T.StructType([T.StructField("a", T.StringType())]), T.StructType([T.StructField("a", T.LongType())])])


def test_trend_by_product(spark):
    rows = [(m, f"p{i}", float(i + m)) for m in range(2) for i in range(250)] + [(0, "p0", -1.0), (0, None, 5.0)]
    df = spark.createDataFrame(rows, "month int, product string, price double")
    got = R.price_trend_by_product(df, "month", "product", "price", 50).collect()
    assert {r.family for r in got} == set(range(5)) and max(len(r.prices) for r in got) < 100
    told = {(r.month, p): x for r in got for p, x in r.prices.items()}
    assert len(told) == 500 and told[0, "p0"] == -1.0 and told[1, "p7"] == 8.0
