"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier decides.

Four fixed patterns give the base spans (email, ip, card, phone), which always stay. Wider patterns propose further spans:
masked addresses, local numbers, national ids, bank accounts, dates of birth, persons, streets and IPv6. On every proposed
and base span vote eight labelers, each for (1), against (-1) or not at all (0): two of form (a strict pattern, a checksum), one of
gazetteers (names, domains, countries, streets), and five of context (cue words, words that speak against it, what it is
glued to, the variety of its digits, other spans nearby).

Spark counts how often each pattern of votes occurs for each kind: at most 12 x 3^8 rows, whatever the corpus's size. From these
counts expectation-maximisation estimates each labeler's votes on true and on other spans and each kind's share of true ones (no
label is read), starting from and held by weak priors that a labeler is better than chance. The expected truth then trains a logistic
classifier over votes, kind and shape of a span (pyspark.ml over counted feature sets of all spans), which decides on the
spans proposed. Nothing is sampled or capped.

Defined results: null and empty texts have no spans; matches of a kind are leftmost and don't overlap; proposed spans that touch a
base span are dropped; places are code points, the end exclusive; repeated documents each count and each get a row; with no
candidate at all nothing is added; further columns are ignored; an empty table gives no rows. Every pattern takes time
linear in the text, also for runs of a million digits or letters.
"""

from __future__ import annotations

import calendar
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfline.llm import common as C

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "masked_email", "local_phone", "national_id", "iban", "birth_date", "person", "address", "ipv6")

# Base patterns. Each begins where a match can begin only once, so that no run is tried from each of its places.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_NAME = r"[A-ZÄÖÜÉÈÑÇÁÍÓÚ][a-zäöüßéèêëñçáíóúâîôû'-]{1,24}"
_BY_DIGITS = {
    "local_phone": re.compile(r"(?<![\w+.,/=:-])(?:\(0?[0-9]{2,4}\) ?|0?[0-9]{2,4}[ ./-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![\w.-])"),
    "national_id": re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z])(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w-])"),
    "address": re.compile(
        rf"(?<!\w)(?:[0-9]{{1,5}} (?:{_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)\b"
        rf"|[A-ZÄÖÜ][a-zäöüß]{{1,24}}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?\b"
        rf"|[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin|impasse)(?: (?:de|du|des|la|le|les|{_NAME})){{1,5}}"
        rf"|(?:Calle|Avenida|Plaza|Paseo)(?: (?:de|del|la|los|las|{_NAME})){{1,5}},? [0-9]{{1,4}}\b)"
    ),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
}
_PERSON = re.compile(rf"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra?)\.? |(?:[Nn]ame|[Nn]om|[Nn]ombre|[Ff]rom|[Dd]e|[Vv]on): ?)({_NAME}(?: {_NAME}){{0,2}})")
_AT = re.compile(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?")
_MASKED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?|\.)[A-Za-z0-9-]{1,63}){1,4}")

# Gazetteers: short lists of common values.
NAMES = frozenset("james john robert michael william david richard thomas mary patricia jennifer linda elizabeth susan sarah anna maria peter paul hans karl klaus jürgen stefan andreas ursula monika petra sabine jean pierre michel philippe marie nathalie isabelle sophie jose juan antonio manuel carlos francisco carmen ana isabel laura lucia elena".split())
DOMAINS = frozenset("com org net edu gov io info de fr es uk us eu at ch it nl be pl ca au co me".split())
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28, "IE": 22}
CUES = re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|e-?mail|mail|contact|reach|write|ssn|social security|dni|iban|account|konto|cuenta|compte|born|birth|dob|geboren|né|née|nacid[oa]|name|nom|nombre|address|adresse|dirección|lives at|wohnt|card|karte|carte|tarjeta|ip|host|from)\b[^\n]{0,24}\Z")
AGAINST = re.compile(r"\b(?:order|invoice|version|release|v|page|isbn|issn|doi|token|password|secret|hash|commit|build|serial|figure|fig|table|chapter|section|article|bestellung|rechnung|seite|commande|facture|pedido|factura|página)\b[\s:=#.\"'-]{0,4}\Z")
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})(?:\.(?:[1-9]?[0-9]|1[0-9]{2}|2[0-9]{2})){3}"),
    "card": re.compile(r"[2-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}"),
    "phone": re.compile(r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"),
    "local_phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ .-]?[0-9]{3,5}"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[0-9]{8}-?[A-HJ-NP-TV-Z]"),
}


class Span(NamedTuple):
    first: int
    last: int
    kind: int


class Seen(NamedTuple):
    """What labelers look at."""

    kind: str
    hit: str
    before: str
    after: str
    near: bool


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            yield first, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def small_parts(hit: str) -> bool:
    return all(len(p := x.lstrip("0")) < 3 or (len(p) == 3 and p <= "255") for x in hit.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    out = [Span(*x, 0) for x in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [Span(*m.span(), 1) for m in _IP.finditer(text) if small_parts(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(*m.span(), 2))
        if "+" in text:
            out += [Span(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s.first, s.kind, s.last))


def masked_emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _AT.finditer(text):
        first = m.start()
        while first > max(free, m.start() - 64) and text[first - 1] in _LOCAL:
            first -= 1
        if first < m.start() and (to := _MASKED.match(text, m.end())):
            yield first, to.end()
            free = to.end()


def proposed(text: str, base: list[Span]) -> list[Span]:
    """Spans that the wider patterns propose and no base span touches."""
    found = [Span(*x, KINDS.index("masked_email")) for x in masked_emails(text)] if _AT.search(text) else []
    found += [Span(*m.span(1), KINDS.index("person")) for m in _PERSON.finditer(text)]
    if _DIGITS.search(text):
        for kind, pattern in _BY_DIGITS.items():
            found += [Span(*m.span(), KINDS.index(kind)) for m in pattern.finditer(text)]
    firsts, reach = [b.first for b in base], list(accumulate((b.last for b in base), max))

    def touched(s: Span) -> bool:
        k = bisect_left(firsts, s.last)
        return k > 0 and reach[k - 1] > s.first

    return [s for s in found if not touched(s)]


def _form(s: Seen) -> int:
    strict = _STRICT.get(s.kind)
    return 0 if strict is None else 1 if strict.fullmatch(s.hit) else -1


def _checksum(s: Seen) -> int:
    if s.kind in ("card", "ip"):
        return 1  # base spans of these kinds have passed theirs
    if s.kind == "iban":
        bare = s.hit.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in bare[4:] + bare[:4])
        return 1 if int(turned) % 97 == 1 else -1
    if s.kind == "national_id" and "A" <= s.hit[-1] <= "Z":
        return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(s.hit[:8]) % 23] == s.hit[-1] else -1
    if s.kind == "birth_date":
        parts = [int(x) for x in re.split(r"[./-]", s.hit)]
        year, month, day = parts if parts[0] > 31 else parts[::-1]
        right = any(1 <= m <= 12 and 1 <= d <= calendar.monthrange(year, m)[1] for m, d in ((month, day), (day, month)))
        return 1 if right and 1900 <= year <= 2030 else -1
    return 0


def _gazetteer(s: Seen) -> int:
    if s.kind == "email":
        return 1 if s.hit.rpartition(".")[2].lower() in DOMAINS else -1
    if s.kind == "masked_email":
        return 1 if re.findall(r"[A-Za-z0-9-]+", s.hit)[-1].lower() in DOMAINS else -1
    if s.kind == "person":
        return 1 if any(w.lower() in NAMES for w in s.hit.split()) else 0
    if s.kind == "iban":
        return 1 if IBAN_LENGTHS.get(s.hit[:2]) == len(s.hit.replace(" ", "")) else -1
    return 1 if s.kind == "address" else 0


def _cue(s: Seen) -> int:
    return 1 if CUES.search(s.before) else 0


def _against(s: Seen) -> int:
    return -1 if AGAINST.search(s.before) else 0


def _glued(s: Seen) -> int:
    sides = s.before[-1:] + s.after[:1]
    return -1 if any(c.isalnum() or c in "_=\"'/#&" for c in sides) else 0


def _variety(s: Seen) -> int:
    digits = [c for c in s.hit if c.isdigit()]
    if len(digits) < 6:
        return 0
    steps = {(ord(b) - ord(a)) % 10 for a, b in zip(digits, digits[1:], strict=False)}
    return -1 if len(set(digits)) < 3 or len(steps) == 1 else 1 if len(set(digits)) >= 4 else 0


def _near(s: Seen) -> int:
    return 1 if s.near else 0


LABELERS = (_form, _checksum, _gazetteer, _cue, _against, _glued, _variety, _near)
NEAR = 80
#: Features of the classifier, as places in one indicator vector: kind, votes for and against, and buckets of shape.
_LENGTHS, _SIDES = (8, 12, 16, 24), 4
N_FEATURES = len(KINDS) + 2 * len(LABELERS) + 2 * _SIDES + len(_LENGTHS) + 1 + 3


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in ".,;:!?()[]{}<>" else 2 if c.isalnum() else 3


def features(s: Seen, votes: list[int]) -> list[int]:
    """Places of the indicators that are set."""
    out, at = [KINDS.index(s.kind)], len(KINDS)
    out += [at + 2 * i + (v < 0) for i, v in enumerate(votes) if v]
    at += 2 * len(LABELERS)
    out += [at + _side(s.before[-1:]), at + _SIDES + _side(s.after[:1])]
    at += 2 * _SIDES
    out.append(at + sum(len(s.hit) > x for x in _LENGTHS))
    at += len(_LENGTHS) + 1
    out.append(at + min(2, sum(not c.isalnum() for c in s.hit) // 2))
    return out


def candidates(text: str) -> tuple[list[Span], list[dict]]:
    """Base spans of a text, and all candidates with their votes and features."""
    base = base_spans(text)
    spans = sorted(base + proposed(text, base), key=lambda s: (s.first, s.kind, s.last))
    out = []
    for i, s in enumerate(spans):
        near = any(0 <= i + d < len(spans) and (spans[i + d].first - s.last if d > 0 else s.first - spans[i + d].last) <= NEAR for d in (-1, 1))
        seen = Seen(KINDS[s.kind], text[s.first : s.last], text[max(0, s.first - 48) : s.first].lower(), text[s.last : s.last + 8], near)
        votes = [f(seen) for f in LABELERS]
        out.append({"first": s.first, "kind": s.kind, "last": s.last, "votes": votes, "x": features(seen, votes)})
    return base, out


_SPAN = "struct<first:int,kind:int,last:int>"


def told(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: _id, base spans, candidates."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], *T.StructType.fromDDL(f"base array<{_SPAN}>, found array<struct<first:int,kind:int,last:int,votes:array<int>,x:array<int>>>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in C.text_groups(batch.column(1)):
                base, found = [], []
                for raw in texts:
                    b, f = candidates(raw.decode("utf-8", "replace"))
                    base.append([s._asdict() for s in b])
                    found.append(f)
                columns = [batch.column(0).slice(first, last - first).cast(arrow.field(0).type), pa.array(base, arrow.field(1).type), pa.array(found, arrow.field(2).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


#: Prior counts of votes (-1, 0, 1) on true spans; on others, the other way round. A kind's share of true spans: 2 of 4.
PRIOR = np.array([2.0, 8.0, 10.0])


def reliabilities(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 200, least_step: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: log odds of each kind (its share of true spans), and of each
    labeler's vote (-1, 0, 1). Their sum is a span's log odds of being true."""
    prior = np.stack([PRIOR[::-1], PRIOR])
    votes_are = votes[:, :, None] == np.array([-1, 0, 1])
    kinds_are = kinds[:, None] == np.arange(len(KINDS))
    theta = np.broadcast_to((prior / prior.sum(1, keepdims=True))[:, None, :], (2, votes.shape[1], 3)).copy()
    share, before = np.full(len(KINDS), 0.5), None
    for _ in range(rounds):
        odds = np.log(share / (1 - share))[kinds] + (votes_are * np.log(theta[1] / theta[0])).sum((1, 2))
        true = 1 / (1 + np.exp(-odds))
        if before is not None and np.abs(true - before).max(initial=0) < least_step:
            break
        before = true
        for y, w in ((0, n * (1 - true)), (1, n * true)):
            counts = (w[:, None, None] * votes_are).sum(0) + prior[y]
            theta[y] = counts / counts.sum(1, keepdims=True)
        share = ((n * true) @ kinds_are + 2) / (n @ kinds_are + 4)
    return np.log(share / (1 - share)), np.log(theta[1] / theta[0])


def _total(weights: np.ndarray, places: Column) -> Column:
    """Sum of the weights at an array of places."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.transform(places, lambda i: F.get(w, i)), F.lit(0.0), lambda a, x: a + x)


def _truth(kind_odds: np.ndarray, vote_odds: np.ndarray, kind: Column, votes: Column) -> Column:
    """Expected truth of a candidate by its labelers' votes."""
    flat = np.concatenate([kind_odds, vote_odds.ravel()])
    places = F.concat(F.array(kind), F.transform(votes, lambda v, i: i * 3 + v + 1 + len(KINDS)))
    return 1 / (1 + F.exp(-_total(flat, places)))


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id, base (spans of the fixed patterns) and spans (these and those that the classifier adds), each (first, kind, last) in order."""
    found = C.staged(told(documents, id_col, text_col), "personal")
    spans = found.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.x")
    counted = C.staged(spans.groupBy("kind", "votes", "x").agg(F.count("*").alias("n")), "personal-counts")
    patterns = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").toArrow()  # at most 12 x 3^8 rows
    added = F.lit(None).cast(f"array<{_SPAN}>")
    if len(patterns):
        kinds, n = (patterns.column(c).to_numpy().astype(np.int64) for c in ("kind", "n"))
        votes = np.array(patterns.column("votes").to_pylist())
        p = _truth(*reliabilities(kinds, votes, n.astype(float)), F.col("kind"), F.col("votes"))
        vector = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda i: F.array_contains("x", i).cast("double"))).alias("features")
        soft = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("s")
        training = counted.withColumn("p", p).select(vector, soft).select("features", "s.label", "s.weight").filter("weight > 0")
        total = float(n.sum())
        model = LogisticRegression(weightCol="weight", regParam=min(0.01, 1 / total), maxIter=60, standardization=False).fit(training)
        weights, cut = model.coefficients.toArray(), float(np.log(least / (1 - least)) - model.intercept)
        true = F.filter("found", lambda c: (c["kind"] >= len(BASE)) & (_total(weights, c["x"]) >= cut))
        added = F.transform(true, lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last")))
    return found.select(F.col("_id").alias(id_col), "base", F.sort_array(F.concat("base", F.coalesce(added, F.array().cast(f"array<{_SPAN}>")))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:first:last of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(C.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
