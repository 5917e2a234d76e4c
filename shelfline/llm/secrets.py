"""Secret scans by DataFrame functions alone: fixed patterns, and a battery of randomness tests.

Patterns give the base spans. The battery looks at every run of 20 or more letters, digits and +/_=- : its encoding is
inferred (hex, base 32, base 36, base 62, base 64), its characters become numbers of that alphabet, and

* chi-squared uniformity over the alphabet, a runs test (above or below the alphabet's middle) and a serial correlation
  test each give a p-value against "this stands at least MARGIN standard deviations off what random characters give";
* the same chi-squared value and the number of changes between small letters, capitals and digits are held against what
  words give: a p-value for "this is text".

A run is a secret if all four are rejected, so that its p-value is the largest of them. These combined p-values go under
false discovery control at rate `fdr` (Benjamini-Hochberg), within runs of like length: short runs carry little evidence,
and long ones don't lend them theirs. p-values are binned by tenths of a decade and rounded up, so that each length
class's threshold follows from its histogram, at most 401 rows for each of 14 classes, whatever the corpus's size.

Defined results: null and empty texts have no spans; matches of each kind are leftmost and don't overlap, kinds may
overlap each other; a run within a base span adds none; places are code points, the end exclusive; repeated documents each
count and each get a row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C

#: The base kinds in order, each with its pattern. Failing matches of the first are dropped afterwards.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run is maximal, so that a match that is too short leaves no longer one behind: the length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings: the pattern of a run of it (pads cut off), and its alphabet in order.
ENCODINGS = [
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _SMALL.upper() + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _SMALL),
    ("^[0-9A-Z]+$", _DIGITS + _SMALL.upper()),
    ("^[0-9A-Za-z]+$", _DIGITS + _SMALL.upper() + _SMALL),
    ("^[0-9A-Za-z_=-]+$", _SMALL.upper() + _SMALL + _DIGITS + "-_="),
    ("^[0-9A-Za-z+/_=-]+$", _SMALL.upper() + _SMALL + _DIGITS + "+/=-_"),
]
#: Sums of squares and cubes of letter frequencies in text of European languages, and how often neighbours
#: in words differ in class.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES = 0.065, 0.0056, 0.06
#: Standard deviations off random characters from which a test's statistic counts as not random.
MARGIN = 7.0


def running_sums(sizes: Column) -> Column:
    """For each place of an array of ints the sum of those before it, by sums of blocks of about the root of its size."""

    def in_blocks(sizes: Column, b: Column) -> Column:
        add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / b).cast("int")), lambda i: add(F.slice(sizes, i * b + 1, b)))
        heads = C.let(blocks, lambda sums: F.transform(sums, lambda _, i: add(F.slice(sums, F.lit(1), i))))
        return C.let(heads, lambda h: F.transform(sizes, lambda _, i: F.get(h, F.floor(i / b).cast("int")) + add(F.slice(sizes, F.floor(i / b).cast("int") * b + 1, i % b))))

    return C.let(F.struct(sizes.alias("v"), F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(sizes)))).cast("int").alias("b")), lambda x: in_blocks(x["v"], x["b"]))


def running_max(v: Column) -> Column:
    """For each place of an array of ints the largest up to it, by maxima of blocks of about the root of its size."""

    def in_blocks(v: Column, b: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda i: F.array_max(F.slice(v, i * b + 1, b)))
        heads = C.let(blocks, lambda tops: F.transform(tops, lambda _, i: F.array_max(F.slice(tops, F.lit(1), i))))
        return C.let(heads, lambda h: F.transform(v, lambda _, i: F.greatest(F.get(h, F.floor(i / b).cast("int")), F.array_max(F.slice(v, F.floor(i / b).cast("int") * b + 1, i % b + 1)))))

    return C.let(F.struct(v.alias("v"), F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v)))).cast("int").alias("b")), lambda x: in_blocks(x["v"], x["b"]))


def up_to(sorted_: Column, value: Column) -> Column:
    """How many of a sorted array are at most a value, by halving."""
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= F.size(sorted_)) & (F.get(sorted_, at + p - 1) <= value), at + p).otherwise(at))


def located(text: Column, pattern: str, keep=None) -> Column:
    """(first, last, text) of each match, from the lengths of matches and of what stands between them."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.length)
        return C.let(gaps, lambda g: with_ends(hits, g))

    def with_ends(hits: Column, gaps: Column) -> Column:
        begins = running_sums(F.zip_with(gaps, hits, lambda g, h: g + F.length(h)))
        firsts = F.zip_with(begins, gaps, lambda b, g: b + g)
        return F.zip_with(firsts, hits, lambda f, h: F.struct(f.alias("first"), (f + F.length(h)).alias("last"), h.alias("hit")))

    none = F.array().cast("array<struct<first:int,last:int,hit:string>>")
    found = C.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    return F.filter(found, keep) if keep else found


def base_spans(text: Column) -> dict[str, Column]:
    long_enough = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6
    return {"assign": located(text, ASSIGN, long_enough), "access": located(text, ACCESS), "hex": located(text, HEX)}


def of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["first"].alias("first"), F.lit(kind).alias("kind"), x["last"].alias("last")))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""

    def tail(a: Column) -> Column:
        t = 1 / (1 + 0.2316419 * a)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) / 2.5066282746310002 * poly

    return F.when(z >= 0, tail(z)).otherwise(1 - tail(-z))


_TESTS = ("p_chi", "p_runs", "p_serial", "p_text")


def battery(run: Column) -> Column:
    """struct(n, p, p_chi, p_runs, p_serial, p_text) of one run; p is the largest of the others."""
    bare = F.regexp_replace(run, "=+$", "")

    def with_alphabet(x: Column) -> Column:
        chosen = F.coalesce(*(F.when(x.rlike(p), F.lit(a)) for p, a in ENCODINGS), F.lit(ENCODINGS[-1][1]))
        return C.let(F.struct(x.alias("text"), chosen.alias("letters"), F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.instr(chosen, c) - 1).alias("v")), tests)

    def tests(s: Column) -> Column:
        n, k = F.length(s["text"]).cast("double"), F.length(s["letters"]).cast("double")
        v, text = s["v"], s["text"]
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2)))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        following = F.slice(v, 2, F.size(v))
        pairs = F.slice(F.zip_with(v, following, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), 1, F.size(v) - 1)
        high = F.size(F.filter(v, lambda x: x >= k / 2)).cast("double")
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["x"] >= k / 2) != (p["y"] >= k / 2))).cast("double")
        mean_runs = 1 + 2 * high * (n - high) / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double"), F.lit(2))) - n * mean * mean
        products = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["y"])
        ends = F.get(v, F.lit(0)) + F.get(v, F.size(v) - 1)
        together = products - mean * (2 * n * mean - ends) + (n - 1) * mean * mean
        changes = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]+", "."), "[A-Z]+", ":"), "[0-9]+", ";")).cast("double") - 1
        facts = F.struct(n.alias("n"), k.alias("k"), chi.alias("chi"), z_chi.alias("z_chi"), runs.alias("runs"), mean_runs.alias("mean_runs"), var_runs.alias("var_runs"), spread.alias("spread"), together.alias("together"), changes.alias("changes"))
        return C.let(facts, verdicts)

    def verdicts(f: Column) -> Column:
        n, k = f["n"], f["k"]
        z_runs = F.when(f["var_runs"] > 0, F.abs(f["runs"] - f["mean_runs"]) / F.sqrt(f["var_runs"])).otherwise(MARGIN)
        z_serial = F.when(f["spread"] > 0, F.abs(f["together"] / f["spread"] + 1 / n) * F.sqrt(n)).otherwise(MARGIN)
        p_off = [upper_tail(MARGIN - z) for z in (f["z_chi"], z_runs, z_serial)]
        text_chi = k + k * (n - 1) * TEXT_SQUARES - n
        text_sd = k / n * F.sqrt(4 * F.pow(n, F.lit(3)) * (TEXT_CUBES - TEXT_SQUARES**2) + 2 * n * n * TEXT_SQUARES)
        z_text = (text_chi - f["chi"]) / text_sd
        z_changes = (f["changes"] - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
        p_text = upper_tail((z_text + F.least(z_changes, F.lit(12.0))) / 1.4142135623730951)
        found = F.struct(n.cast("int").alias("n"), *(p.alias(name) for name, p in zip(_TESTS, (*p_off, p_text), strict=True)))
        return C.let(found, lambda t: F.struct(t["n"].alias("n"), F.greatest(*(t[name] for name in _TESTS)).alias("p"), *(t[name].alias(name) for name in _TESTS)))

    nothing = F.lit(None).cast("struct<n:int,p:double," + ",".join(f"{name}:double" for name in _TESTS) + ">")
    return C.let(bare, lambda x: F.when(F.length(x) >= 16, with_alphabet(x)).otherwise(nothing))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n / 10.0)), F.lit(13)).cast("int")


def evidence(p: Column) -> Column:
    """Bin of a p-value: tenths of a decade, rounded towards no evidence."""
    return F.least(F.lit(400), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40))))).cast("int")


def cutoffs(runs: DataFrame, fdr: float) -> dict[int, int]:
    """For each length class the least bin that Benjamini and Hochberg's procedure rejects."""
    bins = runs.groupBy("length_class", "bin").agg(F.count("*").alias("n")).toArrow().to_pylist()  # at most 14 x 401 rows
    out = {}
    for c in {b["length_class"] for b in bins}:
        own = sorted((b["bin"], b["n"]) for b in bins if b["length_class"] == c)
        m, seen = sum(n for _, n in own), 0
        for b, n in reversed(own):
            seen += n
            if 10 ** (-b / 10) <= fdr * seen / m:
                out[c] = b
    return out


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.001) -> DataFrame:
    """One row per document: id, base (spans of the patterns), spans (these and the battery's), each (first, kind, last) in order. Kinds are places in KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("_id"), text.alias("_text"))
    kinds = [of_kind(v, n) for n, v in enumerate(base_spans(F.col("_text")).values())]
    runs = F.transform(located(F.col("_text"), RUN), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), battery(x["hit"]).alias("t")))
    found = C.staged(rows.select("_id", F.sort_array(F.concat(*kinds)).alias("base"), F.filter(runs, lambda x: x["t"].isNotNull()).alias("runs")), "secret-runs")
    tested = found.select(F.explode("runs").alias("r")).select(length_class(F.col("r.t.n")).alias("length_class"), evidence(F.col("r.t.p")).alias("bin"))
    chosen = cutoffs(tested, fdr)

    def rejected(x: Column) -> Column:
        cut = F.lit(401)
        for c, b in chosen.items():
            cut = F.when(length_class(x["t"]["n"]) == c, F.lit(b)).otherwise(cut)
        return evidence(x["t"]["p"]) >= cut

    def outside(secrets: Column, base: Column) -> Column:
        """Runs that no base span holds: of the base spans that begin no later, none reaches as far."""
        known = F.struct(F.transform(base, lambda s: s["first"]).alias("firsts"), running_max(F.transform(base, lambda s: s["last"])).alias("reach"))
        return C.let(known, lambda k: F.filter(secrets, lambda x: F.coalesce(F.get(k["reach"], up_to(k["firsts"], x["first"]) - 1) < x["last"], F.lit(True))))

    told = C.let(F.filter("runs", rejected), lambda runs: F.when((F.size("base") > 0) & (F.size(runs) > 0), outside(runs, F.col("base"))).otherwise(runs))
    more = of_kind(told, 3)
    return found.select(F.col("_id").alias(id_col), "base", F.sort_array(F.concat("base", more)).alias("spans"))


def told(spans: Column) -> Column:
    """kind:first:last of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


CHUNK = 4096


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each span, or spans that overlap, replaced by mask. Texts are worked on in chunks, as a place in a text is
    found by counting from its start."""

    def chunk(spans: Column, c: Column, i: Column) -> Column:
        size = F.length(c)
        own = F.filter(spans, lambda s: (s["last"] > i * CHUNK) & (s["first"] < i * CHUNK + size))

        def step(a: Column, s: Column) -> Column:
            first, last = F.greatest(s["first"] - i * CHUNK, F.lit(0)), F.least(s["last"] - i * CHUNK, size)
            fresh = first >= a["at"]
            gap = F.substring(c, a["at"] + 1, first - a["at"])
            begun = F.when(s["first"] >= i * CHUNK, F.lit(mask)).otherwise("")
            return F.struct(F.greatest(a["at"], last).alias("at"), F.when(fresh, F.concat(a["out"], gap, begun)).otherwise(a["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(c, a["at"] + 1, size)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return C.let(spans, lambda spans: F.when(F.size(spans) > 0, F.array_join(F.transform(chunks, lambda c, i: chunk(spans, c, i)), "")).otherwise(text))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
