"""Samples that classifiers learn from: bounded by rows, whatever ids repeat; sizes cut before rows are gathered."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shelfline.llm import common, language, quality_classifier, toxicity
from shelfline.llm import statistics as S


@pytest.fixture(scope="module")
def one_id(spark):
    """5000 different texts of one id that is learnt from, among others."""
    hot = spark.range(5000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of one id")).alias("text"))
    rest = spark.range(1, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some other words "), F.col("id").cast("string")).alias("text"))
    return hot.unionByName(rest).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("de"))


def test_one_text_of_each_labelled_id(spark, one_id):
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    labels = labels.unionByName(labels.limit(3))
    told = quality_classifier.labelled_statistics(one_id, labels, "y", F.lit(True), 30, "doc_id", "text")
    assert told.count() == 30 and set(S.NAMES) <= set(told.columns)
    features = toxicity.labelled_features(one_id, labels, "y", F.lit(True), 30, 10**9, 16, "doc_id", "text")
    assert isinstance(features, pa.Table) and len(features) == 30 and features.column_names == ["order", "y", "x"]
    few = toxicity.labelled_features(one_id, labels, "y", F.lit(True), 30, 25, 16, "doc_id", "text")
    assert 1 <= len(few) < 10 and sum(len(x) for x in few.column("x").to_pylist()) <= 25
    assert few.column("order").to_pylist() == features.column("order").to_pylist()[: len(few)]


def test_rows_of_one_id_cost_what_others_do(spark, one_id):
    apart = one_id.withColumn("doc_id", F.when(F.col("doc_id") == 0, F.xxhash64("text") % 10**9).otherwise(F.col("doc_id")))
    took = []
    for df in (apart, one_id):
        began = time.time()
        got = language.identify(df, held=5).select("doc_id", "lang_pred").collect()
        took.append(time.time() - began)
        assert len(got) == 5039
    assert took[1] < 3 * took[0] + 5


def test_equal_rows_are_learnt_once(spark):
    rows = [(0, "the same words", "en")] * 3000 + [(i, f"these are other words {i}", "en") for i in range(100, 130)] + [(i, f"die anderen worte {i}", "de") for i in range(1, 30)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held=5).collect()
    assert len(got) == len(rows) and {(r.doc_id < 30 and r.doc_id > 0, r.lang_pred) for r in got} == {(True, "de"), (False, "en")}


def test_first_rows(spark):
    df = spark.createDataFrame([(i, [0] * n) for i, n in enumerate([5, 4, 3, 50, 1])], "k int, x array<int>")
    ids = lambda most: [r.k for r in common.first_rows(df, F.size("x"), most, "k").collect()]
    assert ids(12) == [0, 1, 2] and ids(3) == [0] and ids(0) == [0] and ids(100) == [0, 1, 2, 3, 4]
    assert common.first_rows(df.limit(0), F.size("x"), 5, "k").collect() == []
