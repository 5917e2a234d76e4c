"""Quality scores by a sparse rule ensemble.

Trees are grown over text statistics; every path from a root to a node is a conjunctive rule (bounds on statistics), such
as "symbols > 0.05 and upper <= 0.3". A logistic regression with a lasso penalty weighs all rules and keeps few; those are
compiled into one Spark column expression, so that scoring is a projection. Trees and weights are fitted by pyspark.ml on
a sample of at most `most_rows` labelled training rows (the documented bound), drawn by a hash of the id.

Defined results: null and empty texts have statistics 0 and get a score like any other; without labels of both kinds
every score is the smoothed share of label 1 (0.5 without labels); labels of null ids or null values are ignored; repeated
labels count as often; repeated documents each get a row; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.llm import statistics as S

#: A rule: for each statistic (above, at most), either None.
Rule = tuple[tuple[str, float | None, float | None], ...]


def labelled_statistics(documents: DataFrame, labels: DataFrame, label: str, fold: Column, most_rows: int, id_col: str, text_col: str) -> DataFrame:
    """y and the statistics of a bounded sample of labelled training rows."""
    named = labels.filter(F.col(label).isin(0, 1) & fold).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"), F.xxhash64(id_col, F.lit(9)).alias("order"))
    chosen = named.distinct().orderBy("order", "y", "id").limit(most_rows).select("id", "y")
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = docs.join(F.broadcast(chosen), "id")  # most_rows bounds what is broadcast
    # Statistics are worked out by the scan's own tasks. Of rows that share an id one is learnt from, the first by a hash
    # of its text, so that the bound holds whatever ids repeat; only the bounded sample is read back in few partitions.
    told = S.with_statistics(rows.withColumn("_h", F.xxhash64("text")), "text")
    kept = [c for c in told.columns if c not in ("id", "y", "_h")]
    best = told.groupBy("id", "y").agg(F.min_by(F.struct(*kept), "_h").alias("_r")).select("y", *(F.col(f"_r.{c}").alias(c) for c in kept))
    return C.staged(best, "labelled").coalesce(4)


def paths(tree: str) -> list[Rule]:
    """Every path of a tree as pyspark.ml describes it (toDebugString)."""
    found: set[Rule] = set()
    open_: list[tuple[int, str, float, bool]] = []
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+\w.]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        open_.append((depth, S.NAMES[int(m[3])], float(m[5]), m[4] == ">"))
        bounds: dict[str, list[float | None]] = {}
        for _, name, at, above in open_:
            low_high = bounds.setdefault(name, [None, None])
            low_high[not above] = at if low_high[not above] is None else (max if above else min)(at, low_high[not above])
        found.add(tuple((k, *v) for k, v in sorted(bounds.items())))
    return sorted(found, key=str)


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for name, above, most in rule:
        if above is not None:
            out = out & (F.col(name) > above)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out.cast("double")


def fit(sample: DataFrame, trees: int, depth: int, lasso: float) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    plain = math.log((good + 0.5) / (n - good + 0.5))
    if good in (0, n):
        return plain, []
    vectors = VectorAssembler(inputCols=S.NAMES, outputCol="x").transform(sample).select("y", "x", *S.NAMES)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, maxBins=64, featureSubsetStrategy="onethird", seed=17).fit(vectors)
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString)}, key=str)
    if not rules:
        return plain, []
    # Each label counts half in all, so that the rarer one is not outvoted.
    weight = F.when(F.col("y") == 1, n / (2 * good)).otherwise(n / (2 * (n - good)))
    told = sample.select("y", weight.alias("weight"), F.array(*map(rule_column, rules)).alias("rules"))
    told = told.select("y", "weight", array_to_vector("rules").alias("x")).coalesce(2).cache()
    try:
        lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(told)
    finally:
        told.unpersist()
    return lr.intercept, [(w, r) for w, r in zip(lr.coefficients.toArray().tolist(), rules, strict=True) if w]


def score_column(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    total = F.lit(float(intercept))
    for w, r in rules:
        total = total + w * rule_column(r)
    return 1 / (1 + F.exp(-total))


def fitted_score(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, id_col: str, text_col: str, most_rows: int, trees: int, depth: int, lasso: float) -> Column:
    """The score of a row that has the statistics of S.NAMES."""
    sample = labelled_statistics(documents, labels, label, C.crc_mod(id_col, folds) != held, most_rows, id_col, text_col)
    return score_column(*fit(sample, trees, depth, lasso))


def score_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 6000, trees: int = 20, depth: int = 3, lasso: float = 0.002) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = fitted_score(documents, labels, label, folds, held, id_col, text_col, most_rows, trees, depth, lasso)
    rows = documents.select(F.col(id_col).alias("_id"), (C.crc_mod(id_col, folds) == held).alias("_held"), F.col(text_col).alias("_text"))
    scored = S.with_statistics(rows, "_text").select("_id", "_held", score.alias("score"))
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 6000, trees: int = 20, depth: int = 3, lasso: float = 0.002) -> DataFrame:
    """The documents, whole, whose score is 0.5 or more."""
    score = fitted_score(documents, labels, label, folds, held, id_col, text_col, most_rows, trees, depth, lasso)
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col(text_col).alias("_text"))
    scored = S.with_statistics(rows, "_text").select("_row", score.alias("_score"), F.monotonically_increasing_id().alias("_n"))
    # The row number holds the filter above the projection: pushed below it, each rule would count the text anew.
    return scored.filter("_score >= 0.5 AND _n >= 0").select("_row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
