"""Queries on pairs over blocks of many rows: the rows of their SQL, and no more rows shuffled than there are listings."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from shelfline.operators import marts, pairs
from shelfline.plans import catalog

from tests.helpers import plain, spark_rows

DAYS, A_DAY = 4, 150


def listings(folder, one_size: bool, spelled: bool = False):
    """DAYS days of A_DAY listings that are all in one block; with `spelled`, each other day has its names in capitals."""
    rng = random.Random(5)
    words = ["red", "hot", "old", "small", "blue", "ring", "gear", "cold"]
    parts = [(k, f"{rng.choice(words)} {rng.choice(words)}" if one_size else "red rod", f"Brand#{rng.randrange(25)}", 10 if one_size else rng.randrange(1, 51)) for k in range(500)]
    shops = [(k, f"shop {k:03d}") for k in range(60)]
    if spelled:
        parts += [(k + 500, n.upper(), b, z) for k, n, b, z in parts]
        shops += [(k + 60, f" {n.upper()}") for k, n in shops]
    rows = [(i, rng.randrange(500) + 500 * (spelled and day % 2), rng.randrange(60) + 60 * (spelled and day % 2), i % 7, rng.randrange(100, 9000) / 100, f"2001-03-{day + 1:02d}") for day in range(DAYS) for i in range(day * A_DAY, day * A_DAY + A_DAY)]
    con = duckdb.connect()
    for name, columns, values in (
        ("part", "p_partkey bigint, p_name varchar, p_brand varchar, p_size int", parts),
        ("supplier", "s_suppkey bigint, s_name varchar", shops),
        ("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_shipdate timestamp", rows),
    ):
        con.sql(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(values[0]))})", values)
        con.sql(f"COPY {name} TO '{folder}/{name}.parquet'")
    return con


def sql_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def shuffled_rows(spark, run):
    """What run() gives, and the rows that its stages shuffle, as where no table is small enough to be broadcast by itself."""
    context = spark.sparkContext
    store, double = context._jsc.sc().statusStore(), context._gateway.jvm.double

    def stages():
        found = store.stageList(None, False, False, context._gateway.new_array(double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    last = max((x.stageId() for x in stages()), default=-1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return out, sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last)


#: By the block that holds all rows of a day.
NO_PAIR_SHUFFLED = {
    "c14_jaccard": "base",
    "c16_brand_conflict": "base",
    "c16_same_brand": "base",
    "c17_exclusive_conflict": "size",
    "c18_qualifier_mismatch": "size",
    "c19_same_volume": "base",
    "c19_volume_mismatch": "base",
    "c20_match_threshold": "base",
    "c21_match_verdict": "base",
    "d03_resolve_pair_ids": "base",
    "d04_join_unordered_pairs": "base",
    "e10_distinct_pairs": "base",
}


@pytest.mark.parametrize("name", sorted(NO_PAIR_SHUFFLED))
def test_no_pair_is_shuffled(spark, tmp_path, name):
    con = listings(tmp_path, NO_PAIR_SHUFFLED[name] == "size")
    want = sql_rows(con, catalog.SQL[name])
    got, shuffled = shuffled_rows(spark, lambda: spark_rows(catalog.QUERIES[name](spark, str(tmp_path))))
    assert got == want
    assert len(want[1]) > 20 * DAYS * A_DAY and shuffled < 12 * DAYS * A_DAY


@pytest.mark.parametrize("tile", [1, 3, 7, 2048])
def test_distinct_pairs_don_t_depend_on_tiles(spark, tile):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randrange(6), f"s{rng.randrange(9)}", f"n{rng.randrange(30)}") for _ in range(400)]
    rows += [(None, 1, "s", "n"), ("x", None, "s", "n"), ("x", 1, None, "n"), ("x", 1, "s", None), ("w", 1, "s", "alone"), ("v", 1, "s1", "n"), ("v", 2, "s2", "m")]
    df = spark.createDataFrame(rows, "b string, day int, shop string, name string")
    got = [tuple(r) for r in pairs.distinct_pairs(df, ["b"], ["day"], "shop", "name", {"n": F.length("name")}, tile).collect()]
    own = [r for r in rows if None not in r]
    want = {(x[0], x[3], len(x[3]), y[3], len(y[3])) for x in own for y in own if x[:2] == y[:2] and x[2] < y[2]}
    assert len(got) == len(want) and set(got) == want
    none = pairs.distinct_pairs(df.limit(0), ["b"], ["day"], "shop", "name", tile=tile)
    assert none.columns == ["b", "name_1", "name_2"] and none.count() == 0


@pytest.mark.parametrize("name", ["d03_resolve_pair_ids", "d04_join_unordered_pairs"])
def test_names_of_several_spellings(spark, tmp_path, name):
    con = listings(tmp_path, False, spelled=True)
    assert spark_rows(catalog.QUERIES[name](spark, str(tmp_path))) == sql_rows(con, catalog.SQL[name])


def test_label_progress_is_counted_in_one_pass(spark, tmp_path):
    n = 700
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * 7 + j * 3).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, shuffled = shuffled_rows(spark, lambda: spark_rows(catalog.QUERIES["e16_label_progress"](spark, str(tmp_path))))
    assert got == sql_rows(con, catalog.SQL["e16_label_progress"]) and shuffled < 3 * n


def test_label_progress_of_two_tables_and_of_one(spark):
    told = spark.createDataFrame([(i, i + 1, v) for i, v in enumerate(["SAME", "DIFFERENT", "odd", None, "SAME", None])], "a int, b int, v string")
    want = {"same": 2, "different": 1, "uncertain": 1, "done": 4, "remaining": 2, "total": 6}
    assert marts.labelled_progress(told, F.col("v")).first().asDict() == want
    assert marts.label_progress(told, told.filter("v IS NOT NULL"), ["a", "b"], "v").first().asDict() == want
    assert marts.labelled_progress(told.limit(0), F.col("v")).first().asDict() == dict.fromkeys(want, 0)
