"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text's features are its character 1- to 3-grams, lower-cased, hashed to 2^`bits` coordinates; their weights are
(1 + log tf) * idf, scaled to length 1. idf comes from all training texts. The model is trained with
follow-the-regularised-leader under an elastic-net penalty on a sample of at most `most_rows` labelled rows with `most_features`
features in all (the documented bounds), drawn evenly from the languages by a hash of the id; a fifth of it is kept aside, on which one temperature is fitted that
calibrates the probabilities. The model, at most 2^bits weights per language, is broadcast.

Defined results: a text that is null or has no letter is `und` with score 0; without labelled rows every text is `und`
with score 0; with one label only, that label with score 1; rows of null lang or null id teach nothing; repeated rows each
get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.llm.ftrl import Ftrl, predict

_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
PIECE = 1 << 20


def term_counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams of a whole text, taken in pieces."""
    out = np.zeros(1 << bits, np.int64)
    low = text.lower()
    shift = np.uint32(32 - bits)
    for at in range(0, len(low), PIECE):
        # Two characters before a piece belong to n-grams that end in it.
        c = np.frombuffer(low[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = min(at, 2)
        h1 = c * _K[0]
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * _K[1] + h1[1:]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * _K[2] + h1[2:]
        for h, salt, skip in ((h1, 1, lead), (h2, 2, max(0, lead - 1)), (h3, 3, 0)):
            h = (h[skip:] ^ (h[skip:] >> np.uint32(16))) * _K[salt % 3]
            out += np.bincount(h >> shift, minlength=1 << bits)
    return out


def document_frequencies(texts: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of those that have each coordinate: sums of each task's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, _, texts in C.text_groups(batch.column(0)):
                for text in filter(None, texts):
                    seen += term_counts(text.decode(), bits) > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "n": pa.array(np.append(seen[at], n))})

    rows = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of one text's scaled vector."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], bits: int, passes: int, alpha: float, l1: float, l2: float) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights by coordinate (the last row is the bias), temperature."""
    langs = sorted({s[0] for s in sample})
    wanted = np.eye(len(langs))
    model = Ftrl((1 << bits) + 1, len(langs), alpha=alpha, l1=l1, l2=l2)
    model.free[-1] = True
    rows = [(langs.index(s[0]), np.append(s[1], 1 << bits), np.append(s[2], 1.0)) for s in sample]
    aside = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    learnt = [r for i, r in enumerate(rows) if i % 5 != 4]
    for p in range(passes):
        for i in np.random.default_rng(p).permutation(len(learnt)):
            y, at, x = learnt[i]
            model.step(at, x, wanted[y])
    w = model.weights()
    scores, told = np.array([x @ w[at] for _, at, x in aside]), np.array([y for y, _, _ in aside])

    def loss(temperature: float) -> float:
        return -float(np.mean(np.log(predict(scores / temperature)[np.arange(len(told)), told] + 1e-12)))

    temperature = min(np.geomspace(0.05, 20, 241), key=loss) if len(langs) > 1 else 1.0
    return langs, w, float(temperature)


def identify(documents: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 4000, most_features: int = 10_000_000, bits: int = 14, passes: int = 3, alpha: float = 0.5, l1: float = 0.05, l2: float = 0.1) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    spark = documents.sparkSession
    fold = C.crc_mod(id_col, folds)
    text, kind = F.col(text_col), documents.schema[id_col].dataType.simpleString()
    train = documents.filter((fold != held) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    n, seen = document_frequencies(train.select(text), bits)
    idf = np.log((1 + n) / (1 + seen)) + 1
    # Rows are drawn by a hash of id and text, each such pair once, however often it or its id stands there.
    own = train.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col, F.lit(3)).alias("order"), text.alias("text"))
    # The first rows of every language, one after the other: a seldom one is learnt as well. Hashes below a share that a
    # language's count gives are enough, so that no language's rows are ever sorted whole.
    counts = own.groupBy("lang").agg(F.approx_count_distinct("order").alias("rows"))
    near = own.select("lang", "order").join(counts, "lang").filter((F.col("order") / float(1 << 63) + 1) / 2 * F.col("rows") <= 2.0 * most_rows + 100).select("lang", "order").distinct()
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    chosen = near.filter(F.col("place") <= most_rows).orderBy("place", "order", "lang").limit(most_rows).select("lang", "order")
    picked = own.join(F.broadcast(chosen), ["order", "lang"]).groupBy("order", "lang").agg(F.first("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in C.text_groups(batch.column(2)):
                found = [tf_idf(term_counts(t.decode(), bits), idf) for t in texts]
                yield pa.RecordBatch.from_pydict({
                    "order": batch.column(0).slice(first, last - first),
                    "lang": batch.column(1).slice(first, last - first),
                    "at": pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                    "x": pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32())),
                })

    told = picked.mapInArrow(vectors, "order long, lang string, at array<int>, x array<float>")
    rows = C.first_rows(told, F.size("at"), most_features, "order", "lang").toArrow()
    at_list, x_list = rows.column("at").combine_chunks(), rows.column("x").combine_chunks()
    sample = [(lang, at_list[i].values.to_numpy().astype(np.int64), x_list[i].values.to_numpy().astype(float)) for i, lang in enumerate(rows.column("lang").to_pylist())]
    langs, w, temperature = fit(sample, bits, passes, alpha, l1, l2)
    shared = spark.sparkContext.broadcast((langs, w.astype(np.float32), temperature, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w, temperature, idf = shared.value
        for batch in batches:
            for first, last, texts in C.text_groups(batch.column(2)):
                names, scores = [], []
                for t in texts:  # asked texts have letters, others are empty
                    if not t or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    at, x = tf_idf(term_counts(t.decode(), bits), idf)
                    p = predict((x @ w[at] + w[-1])[None] / temperature)[0] if len(langs) > 1 else np.ones(1)
                    names.append(langs[int(p.argmax())])
                    scores.append(float(p.max()))
                own = {"id": batch.column(0).slice(first, last - first), "held_out": batch.column(1).slice(first, last - first)}
                yield pa.RecordBatch.from_pydict(own | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    asked = documents.select(F.col(id_col).alias("id"), (fold == held).alias("held_out"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    return asked.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(C.table(spark, sf_dir, "documents"))
