"""A corpus pipeline of five operators: each stage works on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir), with docs the Parquet that the stage before wrote, and returns documents with all
their columns; the last returns the encoded corpus. Keys of rows, given as a stage writes its input once, decide which rows
stay: they are joined by broadcast only after a count shows at most MOST_BROADCAST of them, else by a shuffle.

Defined results: null and empty texts pass the stages as the operators say; rows that repeat an id and its text become one
in the second stage, and rows of one id with different texts, or of null ids, count as documents of their own; an empty
table stays empty through all stages; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, common, decontamination, quality_classifier, secrets, shingles

MOST_BROADCAST = 1_000_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    return name if name not in docs.columns else _free(docs, f"{name}_")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with keys of their own, fixed by writing them once, and the keys' name: ids may be null or repeated."""
    key = _free(docs, "row_key")
    return common.staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays; of wordless rows, one for each id and text."""
    rows, key = _keyed(docs)
    found = common.staged(shingles.similar_groups(rows, id_col=key).select(F.col(key).alias("k"), "component_id"), "groups")
    wordless = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]") & F.col("doc_id").isNotNull()
    told = rows.select(F.col(key).alias("k"), F.col("doc_id").alias("id"), wordless.alias("blank"), F.when(wordless, F.col("text")).alias("blank_text"))
    by = [F.when(~F.col("blank"), F.col("component_id")).alias("c"), F.when(F.col("blank"), F.col("id")).alias("d"), F.col("blank_text").alias("t")]
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k"))
    kept = found.join(told, "k").groupBy(*by).agg(first.alias("first")).select("first.k")
    gone = common.staged(found.select("k").join(kept, "k", "left_anti").select(F.col("k").alias(key)), "copies")
    return rows.join(_sized(gone), key, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, key = _keyed(docs)
    found = decontamination.find_contamination(rows, common.table(spark, sf_dir, "benchmark"), id_col=key)
    gone = common.staged(found.filter(F.size("hits") > 0).select(key), "contaminated")
    return rows.join(_sized(gone), key, "left_anti").select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask, and n_chars follows in the rows that are changed."""
    rows, key = _keyed(docs)
    spans, masked = _free(docs, "secret_spans"), _free(docs, "masked_text")
    found = secrets.scan(rows, id_col=key).filter(F.size("spans") > 0).select(key, F.col("spans").alias(spans))
    joined = rows.join(_sized(common.staged(found, "spans")), key, "left")
    # The mask and its length are worked out one after the other: within one select, `text` would be the new column.
    joined = joined.withColumn(masked, F.when(F.col(spans).isNotNull(), secrets.redacted(F.col("text"), F.col(spans))))
    changed = {"text": F.coalesce(masked, "text").alias("text"), "n_chars": F.coalesce(F.length(masked).cast("long"), F.col("n_chars")).alias("n_chars")}
    return joined.select(*(changed.get(c, F.col(c)) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode(docs, bpe.default_vocabulary()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets_masked),
    ("BPE encoding and decoding", encoded),
]

#: Fitted models, groups by similarity and BPE are beyond SQL; tests hold operators against plain versions and stages against rows worked out by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
