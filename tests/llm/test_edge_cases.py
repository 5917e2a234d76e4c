"""Every operator and stage over nulls, empty and long texts, ties and repeats, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from shelfline.llm import bpe, common, decontamination, language, lm_scoring, quality_classifier, quality_rules, secrets, shingles, toxicity, warc

LONG = "word other third " * 30_000
ROWS = [
    (0, None, None, None, None),
    (1, "", "en", "s", 0),
    (2, "   \n\t", "en", None, 5),
    (3, "A", "en", "s", 1),
    (4, "the same text of more than five words here", "en", "s", 9),
    (5, "the same text of more than five words here", "en", "s", 9),
    (5, "the same text of more than five words here", "en", "s", 9),
    (6, LONG, "de", "s", len(LONG)),
    (7, "x" * 70_000, None, "s", 70_000),
    (8, "!!! ... ???", "fr", "s", 11),
    (9, "ünïcödé 漢字 🙂 token: abcdef123456", "fr", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ["n_words", "score", "id", "sid", "n", "h", "words", "_text", "spans", "row", "y", "order", "bits"]
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 0), (4, 1, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the same text of more than five words here"), (2, None), (3, ""), (4, "A")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda d, l, b: secrets.scan(d),
    "quality": lambda d, l, b: quality_classifier.score_quality(d, l),
    "language": lambda d, l, b: language.identify(d),
    "groups": lambda d, l, b: shingles.similar_groups(d),
    "bpe": lambda d, l, b: bpe.encode(d, bpe.default_vocabulary()),
    "toxicity": lambda d, l, b: toxicity.score_toxicity(d, l),
    "decontamination": lambda d, l, b: decontamination.find_contamination(d, b),
    "rules": lambda d, l, b: quality_rules.apply_rules(d),
    "lm": lambda d, l, b: lm_scoring.score_texts(d, least=1, share=0.001),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(docs, labels, benchmark, name):
    got = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, benchmark, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "language", "toxicity"])
def test_nothing_to_learn_from(docs, labels, benchmark, name):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    got = OPERATORS[name](unlabelled, labels.limit(0), benchmark).collect()
    assert {r.score for r in got} == ({0.0} if name == "language" else {0.5})


def test_pages(spark):
    body = "<p>" + "payload " * 200
    rows = [(1, "u1", body), (3, "u\n3", body), (2, None, body), (3, "u3", body), (4, "u4", None), (5, "u5", ""), (6, "u6", "short"), (7, "u7", "short"), (None, None, body + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("clash"))
    got = warc.read_archives(warc.archive(pages, common.new_path(spark, "warc"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (1, "revisit", 3), (2, "revisit", 3), (3, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0)]
    assert {r.payload.decode() for r in got if r.page_id in (1, 2, 3) and r.payload is not None} == {body}
    assert {r.payload_bytes for r in got if r.page_id in (1, 2, 3)} == {len(body)}
    assert warc.read_archives(warc.archive(pages.limit(0), common.new_path(spark, "warc"))).collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, benchmark, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, f = corpus_pipeline.STAGES[stage]
    for df in (docs, docs.limit(0)):
        out = f(spark, df, str(tmp_path))
        assert out.count() <= df.count()
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_stages_tell_rows_apart_by_more_than_ids(spark, tmp_path):
    """Null and repeated ids: what stays, worked out by hand."""
    fill = lambda tag, n=30: " ".join(f"{tag}{k}" for k in range(n))
    leak, secret = fill("bench", 12), "password = hunter2222"
    spark.createDataFrame([("a", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [
        (None, fill("one")),
        (None, fill("two")),
        (None, fill("three")),
        (1, fill("three") + " more"),  # the null id above is its near copy
        (7, fill("four")),
        (9, fill("four") + " more"),  # a near copy of 7 that shares its id with the next
        (9, fill("five")),
        (5, fill("six")),
        (5, fill("six")),
        (6, " "),
        (6, " "),
        (None, ""),
        (None, ""),
    ]
    df = lambda rows: spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = lambda f, rows: sorted(((r.doc_id or 0, r.text) for r in f(spark, df(rows), str(tmp_path)).collect()))
    want = [(None, fill("one")), (None, fill("two")), rows[3], rows[4], rows[6], rows[7], rows[9], (None, ""), (None, "")]
    assert got(corpus_pipeline.near_duplicates, rows) == sorted((i or 0, t) for i, t in want)
    assert got(corpus_pipeline.decontaminated, [(None, leak), (None, "clean"), (3, "x " + leak), (3, "clean too")]) == [(0, "clean"), (3, "clean too")]
    assert got(corpus_pipeline.secrets_masked, [(None, secret), (4, secret), (4, "nothing here")]) == [(0, "[SECRET]"), (4, "[SECRET]"), (4, "nothing here")]
