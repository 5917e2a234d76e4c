"""Personal data: base spans against the contract's own patterns, the estimate against loops, planted spans, edge cases."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import personal_data as pd_

from tests.conftest import SF
from tests.llm.test_edge_cases import ROWS, SCHEMA


def plain_base(text):
    """The contract's patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d[::-1][0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-1][1::2])
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def base(text):
    return [(s.first, s.kind, s.last) for s in pd_.base_spans(text)]


def test_base_spans_are_the_contracts():
    for (text,) in duckdb.sql(f"SELECT coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall():
        assert base(text) == plain_base(text)
    rng = random.Random(3)
    pieces = ["@", ".", "-", "+", "a", "b.c", "1", "25", "0", "255", "256", "4", " ", "(", ")", "_", "%", "é", "4111 1111 1111 1111", "1.2.3.4", "+1 (2", "a@b.c", "٣", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert base(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("1", "a", "1.", "a@", "+1", "1 ", "1-", "A1", "Mr ", "[at] ", "Aa ", "1 Aa ", "((", "+1(", "a.b@", "12:", "name: "):
        pd_.candidates(unit * (400_000 // len(unit)))
    assert time.time() - began < 60


def plain_estimate(kinds, votes, n, rounds=200):
    theta = [[[x / 20 for x in (10, 8, 2)] for _ in votes[0]], [[x / 20 for x in (2, 8, 10)] for _ in votes[0]]]
    share = dict.fromkeys(kinds, 0.5)
    for _ in range(rounds):
        true = []
        for k, v in zip(kinds, votes, strict=True):
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(theta[1][i][x + 1] / theta[0][i][x + 1]) for i, x in enumerate(v))
            true.append(1 / (1 + math.exp(-odds)))
        for y in (0, 1):
            for i in range(len(votes[0])):
                counts = [10, 8, 2] if y == 0 else [2, 8, 10]
                for v, m, p in zip(votes, n, true, strict=True):
                    counts[v[i] + 1] += m * (p if y else 1 - p)
                theta[y][i] = [c / sum(counts) for c in counts]
        share = {k: (sum(m * p for k2, m, p in zip(kinds, n, true, strict=True) if k2 == k) + 2) / (sum(m for k2, m in zip(kinds, n, strict=True) if k2 == k) + 4) for k in share}
    return {k: math.log(s / (1 - s)) for k, s in share.items()}, [[math.log(theta[1][i][x] / theta[0][i][x]) for x in range(3)] for i in range(len(votes[0]))]


def test_estimate_is_the_plain_one_and_finds_good_labelers():
    rng = random.Random(4)
    rows = {}
    for _ in range(3000):
        kind, true = rng.choice([0, 5]), rng.random() < 0.4
        right = lambda p, true=true: (1 if true else -1) if rng.random() < p else (-1 if true else 1)
        vote = (right(0.95), right(0.9), right(0.85), right(0.5), rng.choice([0, right(0.9)]))
        rows[kind, vote] = rows.get((kind, vote), 0) + 1
    kinds, votes, n = [k for k, _ in rows], [list(v) for _, v in rows], list(rows.values())
    kind_odds, vote_odds = pd_.reliabilities(np.array(kinds), np.array(votes), np.array(n, float))
    want_kinds, want_votes = plain_estimate(kinds, votes, n)
    assert all(abs(kind_odds[k] - w) < 1e-3 for k, w in want_kinds.items())
    assert np.abs(vote_odds - np.array(want_votes)).max() < 1e-3
    weight = vote_odds[:, 2] - vote_odds[:, 0]
    assert weight[0] > weight[1] > weight[2] > 2 > 0.5 > abs(weight[3])


PLANTED = {
    "national_id": ("my ssn is {} thanks", "536-22-8713"),
    "iban": ("please pay to account {} soon", "DE89 3704 0044 0532 0130 00"),
    "local_phone": ("call me, phone {} tonight", "(415) 555-2671"),
    "masked_email": ("write to {} please", "john.smith [at] example [dot] org"),
    "birth_date": ("she was born on {} in town", "17.04.1983"),
    "address": ("their address is {} there", "221 Baker Street"),
    "person": ("the name: {} was given", "Maria Lopez"),
}
CLEAN = ["order {}-{}-{}", "version {}.{}.{}", "token = abc{}-{}-{}x", "page {} {} {}", "isbn {}-{}-{}", "commit {}{}{}"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    rows, where = [], {}
    for i in range(240):
        kind = list(PLANTED)[i % len(PLANTED)]
        template, hit = PLANTED[kind]
        rows.append((i, "some words. " * rng.randrange(5) + template.format(hit)))
        where[i] = (kind, hit)
    rows += [(1000 + i, "other words " * 3 + CLEAN[i % len(CLEAN)].format(*(rng.randrange(100, 999) for _ in range(3)))) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows), where


def test_planted_spans_are_found_and_clean_texts_left_alone(planted):
    df, texts, where = planted
    found = {i: 0 for i in PLANTED}
    for r in pd_.find_personal_data(df).collect():
        got = {(pd_.KINDS[s.kind], texts[r.doc_id][s.first : s.last]) for s in r.spans}
        if r.doc_id >= 1000:
            assert not got, texts[r.doc_id]
        else:
            kind, hit = where[r.doc_id]
            found[kind] += (kind, hit) in got
    total = {k: sum(v[0] == k for v in where.values()) for k in PLANTED}
    assert found == total


def test_base_stays_and_edge_cases(spark):
    rows = [*ROWS, (10, "mail a@b.co or +49 (30) 123456 at 10.0.0.1", "en", "s", 1), (None, "4111 1111 1111 1111", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("clash").alias(c) for c in ("base", "spans", "found", "_id", "kind")))
    got = pd_.find_personal_data(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, [(s.first, s.kind, s.last) for s in r.base]) for r in got), key=key) == sorted(((r[0], plain_base(r[1] or "")) for r in rows), key=key)
    assert all(set(r.base) <= set(r.spans) for r in got)
    assert pd_.find_personal_data(df.limit(0)).collect() == []
    assert [r.spans for r in pd_.find_personal_data(df.filter("doc_id = 3")).collect()] == [[]]


def test_query_counts_base_spans(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    for r in pd_.op13_personal_data(spark, SF).collect():
        want = plain_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in want) for kind in range(4))
        told = [f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) | {""}
