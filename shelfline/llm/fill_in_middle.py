"""Fill-in-middle transformation: each text is cut into prefix, middle and suffix and written in another order.

A unit is a pattern (a code point, a word, a line). `regexp_count` gives a text's number of units n; two cuts are drawn in
0..n from a hash of the id; a pattern made for the row, `(unit{a}+)(unit{b-a}+)(rest)` with counted possessive quantifiers,
captures all three pieces in one match, and the replacement puts them in order. Possessive counts never backtrack and need no
stack, so that a text's length doesn't matter: time and memory are linear in it. All is Columns; nothing is shuffled.

Defined results: null texts are empty; empty texts, texts that hold a sentinel, and a fixed share by hash stay plain; a null id
hashes as an empty one; equal rows have equal results and each its own row; further columns are ignored; an empty table
gives no rows. `restored` gives every text back exactly: pieces hold no sentinel, and none can arise where a piece meets
one, as sentinels begin with one character that each holds only there, and none begins another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C

#: Patterns of units; any text is a sequence of them.
UNITS = {
    "char": "(?s:.)",
    "word": "(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++|[\\x20\\x09-\\x0D]++\\z)",
    "line": "(?:[^\\n]*+\\n|[^\\n]++\\z)",
}
SENTINELS = ("<P>", "<S>", "<M>")
#: Units that are counted together, so that counting doesn't make a string of each unit of a long text.
TOGETHER = 4096


def n_units(text: Column, unit: str) -> Column:
    many = f"\\G{unit}{{{TOGETHER}}}+"  # from the last match's end or not at all: no start is tried twice
    rest = F.regexp_replace(text, many, "")
    return (TOGETHER * F.regexp_count(text, F.lit(many)).cast("long") + F.regexp_count(rest, F.lit(unit))).alias("n")


def hashes(id_: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _order(form: Column, psm: Column | str, spm: Column | str) -> Column:
    return F.when(form == "psm", psm).otherwise(spm)


def _quoted(sentinel: str) -> str:
    """A sentinel as part of a replacement."""
    return sentinel.replace("\\", "\\\\").replace("$", "\\$")


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: id, n (units), form (plain, psm, spm), output, prefix_chars and middle_chars (null if plain)."""
    first = sentinels[0][:1]
    if any(not first or x.rfind(first) != 0 or any(y.startswith(x) for y in sentinels if y is not x) for x in sentinels):
        raise ValueError("sentinels begin with one character that each holds only there, and none begins another")
    piece, (p, s, m) = UNITS.get(unit, unit), sentinels
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counted = rows.select("*", n_units(F.col("_text"), piece), *(h.alias(f"_h{k}") for k, h in enumerate(hashes(F.col("_id"), seed), 1)))
    plain = (F.col("_text") == "") | (F.col("_h3") % 100 >= 100 - plain_percent)
    for x in sentinels:
        plain = plain | F.col("_text").contains(x)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2")]
    drawn = counted.select("_id", "_text", "n", form.alias("form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    counts = [x.cast("string") for x in (F.col("_a"), F.col("_b") - F.col("_a"))]
    pattern = F.concat(F.lit(f"(?s)\\A({piece}{{"), counts[0], F.lit(f"}}+)({piece}{{"), counts[1], F.lit("}+)(.*+)\\z"))
    P, S, M = map(_quoted, sentinels)
    order = _order(F.col("form"), f"{P}$1{S}$3{M}$2", f"{S}$3{P}$1{M}$2")
    output = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    told = drawn.select("_id", "n", "form", output.alias("output"))
    at = {x: F.instr("output", x).cast("long") for x in sentinels}
    prefix = _order(F.col("form"), at[s], at[m]) - at[p] - len(p)
    middle = F.length("output") - at[m] - len(m) + 1
    cut = F.col("form") != "plain"
    return told.select(F.col("_id").alias(id_col), "n", "form", "output", F.when(cut, prefix).alias("prefix_chars"), F.when(cut, middle).alias("middle_chars"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform was given."""
    p, s, m = (f"\\Q{x}\\E" for x in sentinels)
    psm = F.regexp_replace(output, f"(?s)\\A{p}(.*?){s}(.*?){m}(.*+)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{s}(.*?){p}(.*?){m}(.*+)\\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    made = transform(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
h AS (SELECT doc_id, t, n, cast('0x' || h[1:8] AS bigint) AS h1, cast('0x' || h[9:16] AS bigint) AS h2, cast('0x' || h[17:24] AS bigint) AS h3, cast('0x' || h[25:32] AS bigint) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN cast(a AS bigint) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN cast(b - a AS bigint) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
