"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word between, lower-cased (A-Z) and without outer
punctuation, and the stems of longer words (their first 4 to 6 bytes, since words inflect), hashed to 2^`bits` coordinates. Per-coordinate rates and L1 keep few weights, which are broadcast: at most
one for each coordinate, and in truth those that separate the classes. Learning takes a sample of labelled rows of at most
`most_rows`, with `most_features` features in all (the documented bounds), drawn by a hash of the id; their features,
never texts, come to the driver.

Defined results: null and empty texts score by the bias alone; without labels of both kinds every score is the share of
label 1 (0.5 without labels); labels of null ids or null values are ignored; repeated labels count once, and of documents
that share an id one is learnt from; repeated documents each get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.llm.ftrl import Ftrl, predict

#: Letters, digits and all beyond ASCII make words here, so that punctuation around a word doesn't hide it.
WORDS = C.byte_class(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

#: Lengths in bytes at which longer words are cut to stems.
STEMS = (4, 5, 6)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text number) of each word, stem, pair and skip pair; 0 is left for the bias."""
    buf, begins = C.joined(texts)
    starts, ends = C.word_bounds(buf, WORDS)
    h = C.word_hashes(buf, starts, ends)
    owner = np.searchsorted(begins, starts, "right") - 1
    parts, owners = [h], [owner]
    for k in STEMS:
        longer = ends - starts > k
        parts.append(C.mix(C.word_hashes(buf, starts[longer], starts[longer] + k) + np.uint64(k)))
        owners.append(owner[longer])
    for gap, salt in ((1, 11), (2, 29)):
        if len(h) > gap:
            inside = owner[:-gap] == owner[gap:]
            parts.append(C.mix((h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(salt))[inside]))
            owners.append(owner[:-gap][inside])
    at = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    return np.where(at == 0, 1, at), np.concatenate(owners)


def labelled_features(documents: DataFrame, labels: DataFrame, label: str, fold, most_rows: int, most_features: int, bits: int, id_col: str, text_col: str) -> pa.Table:
    """(y, coordinates) of a bounded sample of labelled training rows, in the order of a hash of the id."""
    named = labels.filter(F.col(label).isin(0, 1) & fold).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"), F.xxhash64(id_col, F.lit(5)).alias("order"))
    chosen = named.distinct().orderBy("order", "y", "id").limit(most_rows)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = docs.join(F.broadcast(chosen), "id").select("id", "order", "y", F.xxhash64("text").alias("h"), "text")  # most_rows bounds what is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in C.text_groups(batch.column(4)):
                coordinate, owner = features(texts, bits)
                pair = np.unique(owner * (1 << bits) + coordinate)
                cuts = np.searchsorted(pair, np.arange(len(texts) + 1) << bits)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((pair & ((1 << bits) - 1)).astype(np.int32)))
                own = {name: batch.column(i).slice(at, to - at) for i, name in enumerate(("id", "order", "y", "h"))}
                yield pa.RecordBatch.from_pydict(own | {"x": lists})

    # Of rows that share an id one is learnt from, the first by a hash of its text, so that the bound holds whatever ids repeat.
    kind = documents.schema[id_col].dataType.simpleString()
    told = rows.mapInArrow(run, f"id {kind}, order long, y double, h long, x array<int>").groupBy("id", "order", "y").agg(F.min_by("x", "h").alias("x"))
    return C.first_rows(told, F.size("x"), most_features, "order", "y", "id").select("order", "y", "x").toArrow()


def fit(sample: pa.Table, bits: int, passes: int, alpha: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with weights, and the weights; 0 is the bias."""
    y = sample.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(1, np.int64), np.array([np.log(share / (1 - share))])
    lists = sample.column("x").combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
    # A coordinate met in one text alone can't tell classes apart.
    seen = np.bincount(flat, minlength=1 << bits)
    model = Ftrl(1 << bits, alpha=alpha, l1=l1 * np.sqrt(len(y)), l2=l2)  # chance adds up as the root of the rows
    model.free[0] = True
    rows = []
    for i in range(len(y)):
        own = flat[cuts[i] : cuts[i + 1]]
        rows.append(np.concatenate(([0], own[seen[own] > 1])).astype(np.int64))
    # The rarer label counts more, by the root of the labels' ratio, so that one telling word can suffice.
    heavy = np.sqrt((len(y) - y.sum()) / y.sum())
    for p in range(passes):
        for i in np.random.default_rng(p).permutation(len(y)):
            model.step(rows[i], np.ones(len(rows[i])), y[i : i + 1], heavy if y[i] else 1.0)
    w = model.weights()[:, 0]
    at = np.union1d([0], np.flatnonzero(w))
    return at, w[at]


def score_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 6000, most_features: int = 20_000_000, bits: int = 20, passes: int = 4, alpha: float = 0.3, l1: float = 0.07, l2: float = 1.0) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    spark = documents.sparkSession
    sample = labelled_features(documents, labels, label, C.crc_mod(id_col, folds) != held, most_rows, most_features, bits, id_col, text_col)
    at, weight = fit(sample, bits, passes, alpha, l1, l2)
    shared = spark.sparkContext.broadcast((at, weight))
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = weight
        for batch in batches:
            for first, last, texts in C.text_groups(batch.column(2)):
                coordinate, owner = features(texts, bits)
                told = table[coordinate] != 0
                pair = np.unique(owner[told] * (1 << bits) + coordinate[told])
                sums = np.bincount(pair >> bits, weights=table[pair & ((1 << bits) - 1)], minlength=len(texts)) + table[0]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(first, last - first), "held_out": batch.column(1).slice(first, last - first), "score": pa.array(predict(sums[:, None])[:, 0])})

    rows = documents.select(F.col(id_col).alias("id"), (C.crc_mod(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
