"""Tiles, hyperplanes, the keyword index and positions against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.operators import keywords, pairs, ranks


@pytest.mark.parametrize("tile", [1, 3, 7, 4096])
def test_pairs_don_t_depend_on_tiles(spark, tile):
    rows = [("b", f"s{i:02d}", f"n{i % 5}") for i in range(40)] + [("b", "s01", "n1"), ("b", "s01", "other"), (None, "s1", "n"), ("c", "s1", None), ("c", "s2", "n"), ("d", None, "n"), ("d", "s", "n"), ("e", "alone", "n")]
    df = spark.createDataFrame(rows, "block string, shop string, name string").withColumn("_t", F.lit("clash"))
    got = pairs.blocked_pairs(df, ["block"], "shop", ["name"], tile=tile).collect()
    own = {r for r in rows if r[0] and r[1]}
    want = {(a[0], a[1], a[2], b[1], b[2]) for a in own for b in own if a[0] == b[0] and a[1] < b[1]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert pairs.blocked_pairs(df.limit(0), ["block"], "shop", ["name"]).columns == ["block", "shop_1", "name_1", "shop_2", "name_2"]


def test_no_tile_holds_more_than_two_strips(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("b"), "id")
    dealt = pairs.with_strips(df, ["b"], 500, F.col("id")).withColumn("t", F.explode(pairs.tiles_of(F.col("_strip"), F.col("_strips"))))
    sizes = [r["count"] for r in dealt.groupBy("t.i", "t.j").count().collect()]
    assert len(sizes) == 40 * 41 // 2 and max(sizes) < 2.4 * 500 and dealt.count() == 20_000 * 40


@pytest.mark.parametrize("tile, least", [(512, None), (9, None), (9, 0.5)])
def test_cosines_by_tiles(spark, tile, least):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(8).tolist() for i in range(60)} | {60: [0.0] * 8}
    rows = [(i, i % 2, v) for i, v in vectors.items()] + [(None, 0, [1.0] * 8), (100, 0, None), (101, None, [1.0] * 8), (102, 1, [])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    got = {(r.id_1, r.id_2): r.cosine for r in pairs.scored_pairs(df, ["label"], "id", "v", least, tile).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vectors.items()}
    cos = {(a, b): float(np.clip(unit[a] @ unit[b], 0, 1)) for a in unit for b in unit if a < b and a % 2 == b % 2}
    want = {k: c for k, c in cos.items() if least is None or c >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - c) < 1e-12 for k, c in want.items())


def test_hyperplanes_find_nine_of_ten_near_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 32))
    near = base + rng.standard_normal((400, 32)) * 0.35
    vectors = np.concatenate([base, near, np.repeat(base[:1], 30, 0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, [1.0])], "id long, v array<double>")
    got = {(r.id_1, r.id_2): r.cosine for r in pairs.lsh_pairs(df, "id", "v", 32, least=0.9, tile=100).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(i, j): cos[i, j] for i in range(len(cos)) for j in range(i + 1, len(cos)) if cos[i, j] >= 0.9}
    assert len(want) > 600 and len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(k in want or abs(c - 0.9) < 1e-9 for k, c in got.items())
    assert all(abs(c - cos[k]) < 1e-9 for k, c in got.items())


def test_dictionary_of_a_million_keywords(spark):
    words = spark.range(1_000_000).select(F.lower(F.hex(F.col("id") * 7919 + 1_000_000)).alias("keyword"), F.concat(F.lit("l"), F.col("id") % 97).alias("label"))
    names = spark.range(3000).select("id", F.concat(F.lit("Part "), F.upper(F.hex(F.col("id") * 7919 * 331 + 1_000_000)), F.lit(" of it")).alias("name"))
    got = keywords.dictionary_join(names, "name", words, "keyword", "label")
    assert got.count() == 3000 and got.filter("label <> concat('l', id * 331 % 97) AND id * 331 < 1000000").count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_dictionary_is_the_theta_join(spark, seed):
    rng = random.Random(seed)
    letters = "abAÄé1 "
    names = ["".join(rng.choices(letters, k=rng.randrange(0, 12))) for _ in range(150)] + [None, "", "RED rod"]
    entries = [("".join(rng.choices(letters.lower(), k=rng.randrange(0, 5))), f"l{rng.randrange(3)}") for _ in range(60 * seed + 12)] + [(None, "x"), ("zzz", "never"), ("aab", None)]
    if not seed:
        entries = [e for e in entries if e[0] != ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = {r.id: r.label for r in keywords.dictionary_join(df, "name", spark.createDataFrame(entries, "keyword string, label string"), "keyword", "label", ["RED rod"]).collect()}
    for i, n in enumerate(names):
        hits = [(-len(k.lower()), label, k) for k, label in entries if k is not None and label is not None and n is not None and k.lower() in n.lower()]
        assert got[i] == ("UNKNOWN" if n == "RED rod" or not hits else min(hits)[1])
    assert len(got) == len(names)
    none = spark.createDataFrame([], "keyword string, label string")
    assert {r.label for r in keywords.dictionary_join(df, "name", none, "keyword", "label").collect()} == {"UNKNOWN"}


def test_positions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    got = [(r.x, r.id, r.position) for r in ranks.positions(df, [F.desc("x"), F.col("id")]).collect()]
    want = sorted(((x, i) for x, i, _ in got), key=lambda r: (-r[0], r[1]))
    assert [(x, i, n + 1) for n, (x, i) in enumerate(want)] == sorted(got, key=lambda r: r[2])
    assert ranks.positions(df.limit(0), [F.col("x")]).count() == 0
    same = ranks.positions(spark.range(50).select(F.lit(1).alias("x")), [F.col("x")])
    assert sorted(r.position for r in same.collect()) == list(range(1, 51))
