"""Conversation repair against plain versions of the deduction and of the contract, whole and in chunks."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from shelfline.llm import conversation_repair as cr

FORM = re.compile(r"(s?(ua)+)?")
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def all_repairs(codes, most_inserts=3):
    """Least (cost, audit) over every sequence of edits, by trying them all."""
    best = []

    def go(i, initials, cost, audit, inserts):
        if i == len(codes) and FORM.fullmatch(initials):
            best.append((cost, audit))
        if inserts < most_inserts:
            for x in "ua":
                go(i, initials + x, cost + 5, audit + "I", inserts + 1)
        if i < len(codes):
            code = codes[i]
            go(i + 1, initials, cost + 2, audit + "D", inserts)
            if code != "x":
                extra = 5 if code.isupper() else 0
                go(i + 1, initials + code.lower(), cost + extra, audit + "K", inserts)
                for x in "ua":
                    go(i + 1, initials + x, cost + 1 + extra, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(best)


def forward(codes):
    """The same by a pass over rows, an insert at most before each."""
    cell = {"": (0, "")}
    step = lambda c, a, cost, edit: (c + cost, a + edit)
    put = lambda cells, q, v: cells.__setitem__(q, min(cells.get(q, v), v))
    for code in [*codes, None]:
        for _ in range(2):
            for q, v in list(cell.items()):
                for x, then in cr.NEXT[q].items():
                    if x != "s":
                        put(cell, then, step(*v, 5, "I"))
        if code is None:
            return min(cell[q] for q in ("", "a") if q in cell)
        new = {}
        for q, v in cell.items():
            put(new, q, step(*v, 2, "D"))
            if code != "x":
                extra = 5 if code.isupper() else 0
                for x, then in cr.NEXT[q].items():
                    if x == code.lower():
                        put(new, then, step(*v, extra, "K"))
                    if x != "s":
                        put(new, then, step(*v, 1 + extra, "R"))
        cell = new


def test_agenda_finds_the_lightest_of_all_derivations():
    for n in range(4):
        for codes in itertools.product("suaoSUAx", repeat=n):
            want = all_repairs(codes)
            assert cr.derivation("".join(codes)) == want == forward(codes)


def test_blocks_chain_to_the_same_derivation():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choices("suaouauaUAOx", k=rng.randrange(1, 40)))
        want = forward(codes)
        assert cr.derivation(codes) == want
        assert all(cr.derivation(codes, block) == want for block in (1, 2, 5, 16))
    long = "".join(rng.choices("uaUAx", k=30_000))
    assert cr.derivation(long[:3000]) == forward(long[:3000])
    assert len(cr.derivation(long)[1].replace("I", "")) == len(long)


def plain_repair(rows):
    """rows: (conv, turn, role, text, copies)."""
    out = {}
    for conv, *row in rows:
        turn, role, text, n = row
        out.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * n)
    return {conv: plain_one(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, own in out.items()}


def plain_one(rows):
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    cost, audit = forward(codes)
    lines, left = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)[1:]
        if edit in "IR":
            role = "assistant" if lines and lines[-1][:1] == "u" else "user"
        if edit != "D":
            lines.append(f"{role}:{text}")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    texts = ["Fine.", "Is it?", "no end", "", " \t\n", "Fine.", "ünï 🙂!", None, "tail.  \n", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "usher"]
    rows = [(None, None, None, None, 1), (1, 5, "user", "gone", 0), (1, 6, "user", "gone", 0), (2, -(2**63), "user", "Old.", 1), (2, 2**63 - 1, "assistant", "New.", 1)]
    for conv in range(3, 40):
        for turn in range(rng.randrange(1, 14)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts), rng.choice([0, 1, 1, 1, 2])))
    rows += [(40, t % 50, "user" if t % 2 else "assistant", f"Turn {t}.", 1) for t in range(700)]
    rows += [(41, 3, "user", "the same.", 1)] * 300 + [(41, 4, "user", "the same.", 1)] * 200
    rows += [(None, k, "user", "of no conversation.", 1) for k in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_rows", [cr.CHUNK_ROWS, 3])
def test_same_as_a_plain_version(spark, talks, chunk_rows):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, copies int").repartition(5)
    df = df.select("*", *(F.lit("clash").alias(c) for c in ("conv", "seq", "part", "gaps", "audit", "_code")))
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in cr.repair(df, copies_col="copies", chunk_rows=chunk_rows).collect()}
    want = plain_repair(talks)
    want[2] = (2**63 - 1, *want[2][1:])
    assert got == want
    assert got[1] == (0, 0, 0, 0, 0, 0, "", cr.EMPTY)


def test_other_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, "user", "Yes.", 1), ("b", 1, "assistant", "No", 1)], "conv_id string, turn int, role string, text string, copies int")
    assert {r["conv_id"]: r["audit"] for r in cr.repair(df).collect()} == {"a": "D", "b": "D"}
    assert cr.repair(df.limit(0)).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in (1, None) for t in [*range(60), None]]
    made = cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in made:
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        want = {0: ("assistant", "", 0), 1: ("assistant", "", 1), 2: ("assistant", "One Two Three", 1), 3: ("assistant", "One. Two! Three?", 2), 4: ("user", "One. Two! Three?", 1)}
        assert (r.role, r.text, r.copies) == want.get(kind, ("assistant", "One. Two! Three?", 1))
