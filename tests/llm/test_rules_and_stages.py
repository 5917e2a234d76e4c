"""op9's verdicts against exact quantiles with their fallbacks; null ids; the pipeline's first and last stage row by row."""

import hashlib
import math
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from shelfline.llm import bpe, common, quality_classifier, quality_rules

from tests.llm.test_edge_cases import OPERATORS, ROWS, SCHEMA
from tests.llm.test_edge_cases import benchmark, docs, labels  # noqa: F401 (fixtures)

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    w = SPACED.findall(text)
    full = [x for x in text.split("\n") if SPACED.search(x)]
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for own in places.values() if len(own) > 1 for i in own for j in range(i, i + 5)}
    chars = sum(map(len, w))
    shares = {
        "word_length": chars / max(1, len(w)),
        "symbol_share": len(re.findall(r"[#*$%&|<>]", text)) / max(1, chars),
        "repeated_line_share": (len(full) - len(set(full))) / max(1, len(text.split("\n"))),
        "repeated_word_share": len(repeated) / max(1, len(w)),
    }
    return shares, len(w) < 10 or 100 * len(repeated) > 20 * len(w)


def quantile(values, rank):
    values = sorted(values)
    return values[max(0, math.ceil(rank * len(values)) - 1)]


def test_kept_is_what_exact_quartiles_say(spark):
    rng = random.Random(12)
    sizes = {("en", "big"): 60, ("en", "small"): 6, ("de", "a"): 9, ("de", "b"): 9, (None, "lone"): 5, ("fr", None): 7}
    rows = []
    for (lang, source), n in sizes.items():
        for i in range(n):
            words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60))]
            if i % 5 == 0:
                words = [w * 4 for w in words]
            if i % 7 == 1:
                words = [w + "#" * rng.randrange(1, 4) for w in words]
            text = " ".join(words) if i % 3 else "\n".join([" ".join(words[:4])] * rng.randrange(1, 9) + words)
            rows.append((len(rows), text, lang, source))
    rows.append((len(rows), None, "en", "big"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    facts = {r[0]: plain_statistics(r[1] or "") for r in rows}
    least, names = 15, list(quality_rules.LEAST_SPREAD)

    def peers(lang, source):
        for own in ([r for r in rows if r[2:] == (lang, source)], [r for r in rows if r[2] == lang]):
            if len(own) >= least:
                return own
        return rows

    want = {}
    for i, _, lang, source in rows:
        own, failed = facts[i]
        kept = not failed
        for name in names:
            values = [facts[r[0]][0][name] for r in peers(lang, source)]
            low, high = quantile(values, 0.25), quantile(values, 0.75)
            spread = 3.0 * max(high - low, quality_rules.LEAST_SPREAD[name])
            kept = kept and own[name] <= high + spread and (name not in quality_rules.TWO_SIDED or own[name] >= low - spread)
        want[i] = (failed, kept)
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(df, k=4000, least_rows=least).collect()}
    assert got == want
    assert 0 < sum(k for _, k in want.values()) < sum(not f for f, _ in want.values())


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(spark, docs, labels, benchmark, name):  # noqa: F811
    nameless = spark.createDataFrame([(None, "some words of a text without an id", "en", "s", 3), (None, None, None, None, None)], SCHEMA)
    df = docs.filter("doc_id < 6").unionByName(nameless, allowMissingColumns=True)
    got = OPERATORS[name](df, labels, benchmark).collect()
    count = sum(r[0] < 6 for r in ROWS) + 2
    assert len(got) == count and sum(r.doc_id is None for r in got) == 2


def test_quality_stage_keeps_what_the_classifier_predicts(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    df = common.table(spark, folder, "documents")
    told = {r.doc_id: r.predicted for r in quality_classifier.op2_quality_classifier(spark, folder).collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, df, folder).collect()}
    assert kept == {i for i, p in told.items() if p == 1} and 0 < len(kept) < len(told)


def test_encoded_stage_gives_ids_back(spark):
    rows = [(1, "Some text, ünïcode 漢字."), (2, ""), (3, None), (None, "Some text, ünïcode 漢字.")]
    out = corpus_pipeline.encoded(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in out) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    assert all(list(r.ids) == library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids for r in out)


def test_n_chars_follows_the_text(spark):
    df = spark.createDataFrame([(1, "password = hunter2222 and more", 30), (2, "nothing here", 99)], "doc_id long, text string, n_chars long")
    assert {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.secrets_masked(spark, df, "").collect()} == {(1, "[SECRET] and more", 17), (2, "nothing here", 99)}
