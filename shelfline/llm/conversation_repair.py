"""Conversation structure repair: the cheapest edits that give each conversation the form `(s?(ua)+)?` of role initials.

Repair is deduction. An item (i, state) says that the first i rows can become output that ends in that state: nothing yet,
after the system turn, after a user's, after an assistant's. An edit is a hyperedge from an item (and the row that it reads) to
the next: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty user's or
assistant's turn 5; a truncated row that stays adds 5. Knuth's agenda pops items by their weight (cost, rows read, audit), the
audit being the edits' initials in order; the first time that a goal item (all rows, nothing or after an assistant) is popped,
its derivation is the lightest, so that of equal costs the least audit in ASCII wins. Edits are superior functions: none lowers a cost,
and rows read or the audit grow. They are monotone: of two audits of equal cost over the same rows none begins the other,
since a longer one would hold more inserts.

How it is spread: rows are dealt by ranges of (conversation, turn, role, text), so that a conversation of any size goes to as many
tasks as it needs, in order. Those that lie within a task and are short are repaired there. The others leave bounded chunks of
rows, each with one letter a row for the agenda; letters of one conversation meet in one row, as its audit must, blocks of
them become items from state to state, chained by the same agenda, and chunks stream through one hash in order (a hash of a
whole text can't be worked out in parts). Repeated rows are found by counts of their digests, and equal rows of one turn are
counted before rows are dealt.

Defined results: null roles and texts are one space, null turns come first; rows of one turn are taken by role, then text; a row
may stand `copies` times (0: it only names its conversation); a null conversation is one of its own; conversations without
rows give zeros, an empty audit and the hash of an empty string; gaps ignore null turns and end at 2^63 - 1; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfline.llm import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: States of the output so far ("" nothing, else its last initial) and what each initial leads to.
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
GOALS = ("", "a")
#: What a row is to the agenda: its initial, in capitals if truncated ("o": another); MUST_GO for blank and duplicate rows.
MUST_GO = "x"
#: Repeated turns are broadcast up to this count (some 20 MB: an id, a digest and a turn each), else joined.
MOST_BROADCAST = 200_000
BLOCK, CHUNK_ROWS, CHUNK_BYTES = 1024, 1024, 1 << 20
FULL = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


def edits(state: str, code: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(initial, rows read, cost, next state) of each edit at a state; the row's code is None past the end."""
    for initial, then in NEXT[state].items():
        if initial != "s":
            yield "I", 0, INSERT, then
    if code is None:
        return
    yield "D", 1, DELETE, state
    if code != MUST_GO:
        extra = TRUNCATED if code.isupper() else 0
        for initial, then in NEXT[state].items():
            if initial == code.lower():
                yield "K", 1, KEEP + extra, then
            elif initial != "s":
                yield "R", 1, REROLE + extra, then


@lru_cache(1 << 14)
def lightest(codes: str, state: str, to_end: bool) -> dict[str, tuple[int, str]]:
    """Cost and audit of the lightest derivation over the rows, from a state: to the goal, or, of a block that others
    follow, to each state that its last row leaves (what is inserted after that belongs to the next block)."""
    n, out, final = len(codes), {}, set()
    agenda = [(0, 0, "", state)]
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if not to_end:
                out[state] = (cost, audit)
                continue
            if state in GOALS:
                return {state: (cost, audit)}
        for initial, rows, price, then in edits(state, codes[i] if i < n else None):
            if (i + rows, then) not in final:
                heapq.heappush(agenda, (cost + price, i + rows, audit + initial, then))
    return out


class Chained:
    """An item over whole blocks; its audit is what came before and one piece more."""

    __slots__ = ("at", "before", "cost", "piece", "state")

    def __init__(self, cost: int, at: int, state: str, before: Chained | None, piece: str):
        self.cost, self.at, self.state, self.before, self.piece = cost, at, state, before, piece

    def __lt__(self, other: Chained) -> bool:
        if (self.cost, self.at) != (other.cost, other.at):
            return (self.cost, self.at) < (other.cost, other.at)
        x, y, px, py = self, other, "", ""
        while x is not y:
            px, py, x, y = x.piece, y.piece, x.before, y.before
        return px < py


def derivation(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(codes) <= block:
        (found,) = lightest(codes, "", True).values()
        return found
    parts = [codes[i : i + block] for i in range(0, len(codes), block)]
    agenda, final = [Chained(0, 0, "", None, "")], set()
    while True:
        item = heapq.heappop(agenda)
        if item.at == len(parts):
            break
        if (item.at, item.state) in final:
            continue
        final.add((item.at, item.state))
        for then, (cost, piece) in lightest(parts[item.at], item.state, item.at + 1 == len(parts)).items():
            heapq.heappush(agenda, Chained(item.cost + cost, item.at + 1, then, item, piece))
    cost, pieces = item.cost, []
    while item.before:
        pieces.append(item.piece)
        item = item.before
    return cost, "".join(reversed(pieces))


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: str) -> Iterator[tuple[str, str]]:
    """(role:text, state after it) of the rows that the edits leave."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = FULL["a" if state == "u" else "u"]
        state = NEXT[state][role[:1]]
        yield f"{role}:{text}", state


def sha256(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def coded(rows: DataFrame) -> DataFrame:
    """Rows (_c, _t, _r, _x, _n) with what is known of each alone, and whether its role and text stand in an earlier turn.
    Equal rows of one turn are one row of more copies."""
    core = F.rtrim(F.col("_x"), F.lit(C.SPACES.decode()))
    whole = F.concat(F.length("_r").cast("string"), F.lit(":"), "_r", "_x")
    own = rows.withColumn("_d", F.when((F.col("_n") > 0) & (core != ""), F.unhex(F.sha2(whole.cast("binary"), 256))))
    times = own.filter("_d IS NOT NULL").groupBy("_c", "_d").agg(F.count("*").alias("_k"), F.min(F.struct("_t")).alias("_first")).filter("_k > 1")
    times = C.staged(times.select(F.col("_c").alias("_c2"), F.col("_d").alias("_d2"), "_first"), "repeated")
    e = F.broadcast(times) if times.count() <= MOST_BROADCAST else times
    found = own.join(e, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_d") == F.col("_d2")), "left")
    once = found.filter("_first IS NULL").select("_c", "_t", "_r", "_x", "_n", F.lit(False).alias("_again"))
    again = (F.col("_first") < F.struct("_t")).alias("_again")
    more = found.filter("_first IS NOT NULL").groupBy("_c", "_t", "_r", "_d", "_first").agg(F.first("_x").alias("_x"), F.sum("_n").alias("_n")).select("_c", "_t", "_r", "_x", "_n", again)
    both = once.unionByName(more)
    blank, initial = core == "", F.left("_r", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = ~F.right(core, F.lit(1)).isin(".", "!", "?")
    return both.select("*", F.when(blank, "b").when(F.col("_again"), "d").when(cut, F.upper(initial)).otherwise(initial).alias("_code"), initial.alias("_initial")).drop("_again")


class Part:
    """Rows of one conversation in order, and what is counted over them."""

    def __init__(self, conv):
        self.conv, self.seq, self.known = conv, 0, True
        self.clear()

    def clear(self) -> None:
        self.codes, self.rows, self.size = [], [], 0
        self.lo = self.hi = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = ""

    def add(self, turn, role, text, n, code, initial) -> None:
        if not n:
            return
        if turn is not None and turn != self.hi:
            self.lo, self.hi, self.distinct = turn if self.lo is None else self.lo, turn, self.distinct + 1
        self.illegal += (self.last != "" and self.last + initial not in LEGAL) + n - 1
        self.first, self.last = self.first or initial, initial
        if code == "b":
            self.blank += n
        elif code == "d":
            self.duplicate += n
        else:
            self.duplicate += n - 1
            self.truncated += code.isupper()
        self.codes.append(MUST_GO * n if code in "bd" else code + MUST_GO * (n - 1))
        self.rows.append((role, text, n))
        self.size += len(role) + len(text)

    @property
    def large(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.size >= CHUNK_BYTES

    def each(self) -> Iterator[tuple[str, str]]:
        return ((role, text) for role, text, n in self.rows for _ in range(n))

    def counts(self) -> dict:
        return {k: getattr(self, k) for k in ("lo", "hi", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last")} | {"codes": "".join(self.codes)}


def told(counts: dict) -> dict:
    """Result columns, but for the hash, of a whole conversation's counts."""
    cost, audit = derivation(counts["codes"])
    gaps = 0 if counts["hi"] is None else min(counts["hi"] - counts["lo"] + 1 - counts["distinct"], 2**63 - 1)
    return {"gaps": gaps, "cost": cost, "audit": audit} | {k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")}


_COUNTS = "lo long, hi long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, codes string"
_RESULT = "gaps long, cost long, audit string"


def _schema(conv: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv)] + T.StructType.fromDDL(ddl).fields)


def _sent(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def conversations_of(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Coded rows, dealt in order, as results of short conversations (seq null) and chunks of all others."""
    order = [F.col("_c").asc_nulls_first(), F.col("_t").asc_nulls_first(), F.col("_r").asc()]
    dealt = rows.repartitionByRange(*order, F.left("_x", F.lit(32)).asc()).sortWithinPartitions(*order, F.col("_x").asc())
    schema = _schema(rows.schema["_c"].dataType, f"part int, seq int, {_COUNTS}, {_RESULT}, repaired_sha256 string, roles array<string>, texts array<string>, n array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, now, first = TaskContext.get().partitionId(), [], 0, None, True

        def chunk() -> dict:
            made = {"conv": now.conv, "part": part, "seq": now.seq} | now.counts() | {k: [r[i] for r in now.rows] for i, k in enumerate(("roles", "texts", "n"))}
            now.seq += 1
            now.clear()
            return made

        def whole() -> dict:
            counts = now.counts()
            result = told(counts)
            lines = [line for line, _ in repaired(result["audit"], now.each(), "")]
            return {"conv": now.conv, "repaired_sha256": sha256(lines)} | result

        for batch in batches:
            for conv, turn, role, text, n, code, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        size += now.size
                        out.append(chunk() if first or now.seq else whole())
                        first = False
                    now = Part(conv)
                now.add(turn, role, text, n, code, initial)
                if now.size >= CHUNK_BYTES or len(now.rows) >= chunk_rows:
                    size += now.size
                    out.append(chunk())
                if len(out) >= 4096 or size >= 4 * CHUNK_BYTES:
                    yield _sent(out, arrow)
                    out, size = [], 0
        if now is not None:
            out.append(chunk())
        yield _sent(out, arrow)

    return dealt.select("_c", "_t", "_r", "_x", "_n", "_code", "_initial").mapInArrow(run, schema)


def chunked_results(chunks: DataFrame) -> DataFrame:
    """Results of conversations that are chunks of one task or more."""
    conv = chunks.schema["conv"].dataType
    meta = ["part", "seq", *(f.name for f in T.StructType.fromDDL(_COUNTS))]
    lists = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*meta))).alias("chunks"))
    counts = "blank long, duplicate long, truncated long, illegal long"
    schema = _schema(conv, f"{_RESULT}, {counts}, pieces array<struct<part:int,seq:int,piece:string,state:string>>")
    arrow = to_arrow_schema(schema)

    def joined(parts: list[dict]) -> dict:
        all_ = {k: sum(p[k] for p in parts) for k in ("distinct", "blank", "duplicate", "truncated", "illegal")} | {"lo": None, "hi": None}
        last = ""
        for p in parts:
            if p["hi"] is not None:
                all_["distinct"] -= p["lo"] == all_["hi"]
                all_["lo"], all_["hi"] = p["lo"] if all_["lo"] is None else all_["lo"], p["hi"]
            if p["first"]:
                all_["illegal"] += last != "" and last + p["first"] not in LEGAL
                last = p["last"]
        return all_ | {"codes": "".join(p["codes"] for p in parts)}

    def pieces(parts: list[dict], audit: str) -> Iterator[dict]:
        """The edits that read each chunk's rows, with the state before them; inserts after all rows are the last chunk's."""
        at, state, codes = 0, "", "".join(p["codes"] for p in parts)
        row = 0
        for k, p in enumerate(parts):
            begun, before, end = at, state, row + len(p["codes"])
            while at < len(audit) and (row < end or k + 1 == len(parts)):
                edit = audit[at]
                if edit in "IR":
                    state = "a" if state == "u" else "u"
                elif edit == "K":
                    state = codes[row].lower()
                row += edit != "I"
                at += 1
            yield {"part": p["part"], "seq": p["seq"], "piece": audit[begun:at], "state": before}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                result = told(joined(row["chunks"]))
                yield _sent([{"conv": row["conv"], "pieces": list(pieces(row["chunks"], result["audit"]))} | result], arrow)

    solved = C.staged(lists.mapInArrow(solve, schema), "repairs")
    edits_of = solved.select(F.col("conv").alias("_conv"), F.explode("pieces").alias("_p"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_p.part")) & (F.col("seq") == F.col("_p.seq"))
    streams = chunks.select("conv", "part", "seq", "roles", "texts", "n").join(edits_of, same).select("conv", "part", "seq", "roles", "texts", "n", F.col("_p.piece").alias("piece"), F.col("_p.state").alias("state"))
    hashed = to_arrow_schema(_schema(conv, "sha string"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, begun = None, None, False
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if running is None or row["conv"] != conv:
                    if running is not None:
                        yield _sent([{"conv": conv, "sha": running.hexdigest()}], hashed)
                    conv, running, begun = row["conv"], hashlib.sha256(), False
                each = ((r, x) for r, x, n in zip(row["roles"], row["texts"], row["n"], strict=True) for _ in range(n))
                for line, _ in repaired(row["piece"], each, row["state"]):
                    running.update((f"\n{line}" if begun else line).encode())
                    begun = True
        if running is not None:
            yield _sent([{"conv": conv, "sha": running.hexdigest()}], hashed)

    ordered = streams.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    shas = ordered.mapInArrow(hashes, _schema(conv, "sha string")).withColumnRenamed("conv", "_conv")
    return solved.join(shas, F.col("conv").eqNullSafe(F.col("_conv"))).withColumnRenamed("sha", "repaired_sha256")


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: its id, gaps and faults, cost and audit of the cheapest repair, and the repaired text's hash."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.coalesce(F.col(copies_col).cast("long"), F.lit(0)) if copies_col else F.lit(1).cast("long")
    rows = conversations.select(F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"), space(role_col).alias("_r"), space(text_col).alias("_x"), copies.alias("_n"))
    parts = C.staged(conversations_of(coded(rows), chunk_rows), "conversations")
    done = parts.filter("seq IS NULL").select("conv", *_COLUMNS)
    return done.unionByName(chunked_results(parts.filter("seq IS NOT NULL")).select("conv", *_COLUMNS)).withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a hash of their place; `copies` is 0 for those dropped and 2 for those repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(C.table(spark, sf_dir, "conversations")), copies_col="copies")


def _plus(item: str, cost: str, initial: str) -> str:
    """SQL of an item (nine digits of cost, then the audit) after one more edit."""
    return f"(printf('%09d', cast({item}[1:9] AS int) + {cost}) || {item}[10:] || '{initial}')"


def _after_row(to: str, sources: tuple[str, ...], initial: str) -> str:
    kept = "".join(f", CASE WHEN c = '{initial}' THEN {_plus(x, 'x', 'K')} END" for x in sources)
    reroled = "" if initial == "s" else "".join(f", CASE WHEN NOT must THEN {_plus(x, '1 + x', 'R')} END" for x in sources)
    return f"least({_plus(to, '2', 'D')}{kept}{reroled})"


#: A plain forward pass over rows: of each state (e, s, u, a) the least cost and audit as one string that sorts.
OP11_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
k AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '), ''), lambda x: cast(ascii(x) AS bigint)) AS b FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS n(n)),
o AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (
  SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x,
    CASE WHEN fault NOT IN ('blank', 'duplicate') THEN role[1] END AS c FROM f),
p AS (
  SELECT DISTINCT conv_id, 0::bigint AS i, '000000000' AS e, NULL::varchar AS s, NULL::varchar AS u, NULL::varchar AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {_plus("e", "2", "D")}, {_after_row("s", ("e",), "s")}, {_after_row("u", ("e", "s", "a"), "u")}, {_after_row("a", ("u",), "a")}
  FROM (SELECT q.conv_id, g.i, e, s, u, least(a, {_plus("u", "5", "I")}) AS a, must, x, c
    FROM (SELECT conv_id, i, e, s, a, least(u, {_plus("e", "5", "I")}, {_plus("s", "5", "I")}, {_plus("a", "5", "I")}) AS u FROM p) q
    JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i + 1)),
z AS (
  SELECT conv_id, least(e, a, {_plus("u", "5", "I")}, {_plus(_plus("s", "5", "I"), "5", "I")}) AS best
  FROM (SELECT conv_id, arg_max(e, i) AS e, max(i) AS n FROM p GROUP BY conv_id) m JOIN (SELECT conv_id AS pc, i, s, u, a FROM p) l ON l.pc IS NOT DISTINCT FROM m.conv_id AND l.i = m.n),
r AS (
  SELECT conv_id, best[10:] AS audit, 0::bigint AS pos, 0::bigint AS i, '' AS state, NULL::varchar AS lines FROM z
  UNION ALL
  SELECT r.conv_id, audit, pos + 1, r.i + (edit <> 'I')::bigint, CASE edit WHEN 'D' THEN state WHEN 'K' THEN g.role[1] ELSE (CASE state WHEN 'u' THEN 'a' ELSE 'u' END) END,
    CASE WHEN edit = 'D' THEN lines ELSE coalesce(lines || chr(10), '') || (CASE edit WHEN 'K' THEN g.role ELSE (CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END) END) || ':' || (CASE edit WHEN 'I' THEN '' ELSE g.text END) END
  FROM (SELECT *, audit[pos + 1] AS edit FROM r WHERE pos < length(audit)) r LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1 AND edit <> 'I'),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND coalesce(before, '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cast(best[1:9] AS bigint) AS cost, r.audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM z LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM z.conv_id JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.pos = length(r.audit)
"""
