"""Fill-in-middle against a plain version, by unit, and on edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from shelfline.llm import fill_in_middle as fim

PLAIN_UNITS = {"char": r"(?s:.)", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "line": r"[^\n]*\n|[^\n]+\Z"}
TEXTS = [None, "", "x", "<P>", "a<S>b", "<M", "\n\n", "ünï 漢字 🙂🙂 end", "two words\nand a line\n\nlast", "$1 \\ {2} <S <P", "word " * 30_000, "🙂" * 9000, "x" * 70_000, " \t", "line\n" * 5000]


def plain_version(doc_id, text, unit, seed):
    text = text or ""
    units = re.findall(PLAIN_UNITS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@pytest.mark.parametrize("unit", fim.UNITS)
def test_same_as_a_plain_version(spark, unit):
    rows = [(k % 211 if k else None, TEXTS[k % len(TEXTS)]) for k in range(20 * len(TEXTS))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).select("*", *(F.lit("clash").alias(c) for c in ("n", "form", "output", "_a")))
    made = fim.transform(df, unit=unit, seed=3)
    got = [tuple(r) for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    want = [(i, *plain_version(i, t, unit, 3), t or "") for i, t in rows]
    flat = lambda rows: sorted(map(str, rows))
    assert flat(got) == flat(want)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert made.limit(0).count() == fim.transform(df.limit(0)).count() == 0


def test_other_sentinels(spark):
    df = spark.createDataFrame([(k, "some $ text \\ of <P> its own") for k in range(40)], "doc_id long, text string")
    marks = ("\x02$pre\\", "\x02suf$1", "\x02mid")
    made = fim.transform(df, sentinels=marks)
    assert {r[0] for r in made.select(fim.restored(F.col("output"), F.col("form"), marks)).collect()} == {"some $ text \\ of <P> its own"}
    assert made.filter("form <> 'plain'").filter(F.length("output") != 28 + sum(map(len, marks))).count() == 0
    for bad in (("<P>", "<S>", "<S>x"), ("<P>", "{S}", "<M>"), ("", "<S>", "<M>"), ("<P><", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)
