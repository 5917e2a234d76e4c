"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `size` consecutive words of a benchmark item (an item of fewer words, but at least one, is one
pattern). For each pattern length a shift table over blocks of two words tells how far a cursor may jump, since no
pattern has that block nearer to its end; where the shift is nought, the block's bucket holds the patterns that may end
there, and a direct comparison, word by word and at last byte by byte, confirms an occurrence.

Patterns reach the executors in blocks of at most `block_windows`, so that what is broadcast never grows past that; a
larger benchmark takes more passes in the same stage, chained over the documents, and no shuffle.

Defined results: null and empty texts have no words and no hits; null items have no patterns, and those of an item of null id hit, though it isn't named; repeated documents each
get their own row; repeated items keep their own ids; an empty benchmark hits nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import common as C

#: Letters a-z, digits and all beyond ASCII make words.
WORDS = C.byte_class(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_BITS = 18


class Patterns:
    """Shift tables, buckets and pattern words of one pattern length."""

    def __init__(self, words: list[tuple[bytes, ...]], owners: list[list[str]]):
        self.m, self.texts, self.owners = len(words[0]), [b" ".join(w) for w in words], owners
        buf, _ = C.joined(self.texts, lower=False)
        begins, ends = C.word_bounds(buf, WORDS)
        self.words = C.word_hashes(buf, begins, ends).reshape(len(words), self.m)
        self.width = min(2, self.m)
        self.shift = np.full(1 << _BITS, self.m - self.width + 1, np.int32)
        for end in range(self.width - 1, self.m):  # the last word of a block; nearer to the end is smaller
            np.minimum.at(self.shift, self.slots(self.words, end), self.m - 1 - end)
        slots = self.slots(self.words, self.m - 1)
        self.order = np.argsort(slots, kind="stable")
        self.count = np.bincount(slots, minlength=1 << _BITS)
        self.head = np.cumsum(self.count) - self.count

    def slots(self, words: np.ndarray, end: int) -> np.ndarray:
        return slot(words[:, end - 1] if self.width > 1 else words[:, end], words[:, end], self.width)

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, slot) wherever the shift is nought. Many cursors run side by side, each over its own stretch."""
        n = len(h)
        if n < self.m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(self.m - 1, n, 256, dtype=np.int64)
        to = np.minimum(at + 256, n)
        ends, slots = [], []
        while len(at):
            s = slot(h[at - 1] if self.width > 1 else h[at], h[at], self.width)
            step = self.shift[s]
            found = step == 0
            ends.append(at[found])
            slots.append(s[found])
            at = at + np.maximum(step, 1)
            alive = at < to
            at, to = at[alive], to[alive]
        return np.concatenate(ends), np.concatenate(slots)

    def occurrences(self, h: np.ndarray, text_of) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each confirmed occurrence."""
        ends, slots = self.candidates(h)
        k = 0
        while len(ends):
            more = self.count[slots] > k
            ends, slots = ends[more], slots[more]
            pattern = self.order[self.head[slots] + k]
            same = np.ones(len(ends), bool)
            for j in range(self.m):  # most fail at once
                left = np.flatnonzero(same)
                same[left] = h[ends[left] - self.m + 1 + j] == self.words[pattern[left], j]
            for e, p in zip((ends[same] - self.m + 1).tolist(), pattern[same].tolist(), strict=True):
                if text_of(e, e + self.m) == self.texts[p]:
                    yield e, p
            k += 1


def slot(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    h = b * _K2 if width == 1 else (a * _K1) ^ (b * _K2)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def item_words(text: str | None) -> list[bytes]:
    buf, _ = C.joined([(text or "").encode()])
    raw = buf.tobytes()
    return [raw[b:e] for b, e in zip(*(x.tolist() for x in C.word_bounds(buf, WORDS)), strict=True)]


def compiled(items: Iterable[tuple[str, str | None]], size: int) -> list[Patterns]:
    """Patterns of some items, by length."""
    found: dict[int, dict[tuple[bytes, ...], dict[str, None]]] = {}
    for item, text in items:
        w = item_words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(tuple(w[i : i + m]), {})[item] = None
    return [Patterns(list(p), [list(o) for o in p.values()]) for _, p in sorted(found.items())]


def item_blocks(items: DataFrame, size: int, block_windows: int) -> Iterator[list[Patterns]]:
    """Items come to the driver row by row and leave in blocks of bounded size."""
    block, n = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        n += max(1, len(text or "") // 4)
        if n >= block_windows:
            yield compiled(block, size)
            block, n = [], 0
    if block:
        yield compiled(block, size)


def search(texts: list[bytes], tables: list[Patterns]) -> list[tuple[int, list[list[int]], list[str]]]:
    """For each text: its number of words, the hit stretches of words (disjoint, in order), and the items hit."""
    buf, begins = C.joined(texts)
    starts, ends = C.word_bounds(buf, WORDS)
    h = C.word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, begins)
    raw = buf.tobytes()
    cover = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set[str]] = {}

    def text_of(i: int, j: int) -> bytes:
        return b" ".join(raw[b:e] for b, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True))

    for t in tables:
        for at, p in t.occurrences(h, text_of):
            doc = int(np.searchsorted(first, at, "right")) - 1
            if at + t.m <= first[doc + 1]:
                cover[at] += 1
                cover[at + t.m] -= 1
                items.setdefault(doc, set()).update(o for o in t.owners[p] if o is not None)
    # An occurrence never leaves its document, so a stretch that reaches a document's end is cut there.
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        runs: list[list[int]] = []
        if d in items:
            edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
            runs = np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))).tolist()
        out.append((b - a, runs, sorted(items.get(d, ()))))
    return out


_RUNS = "array<struct<first:int,last:int>>"


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = 300_000) -> DataFrame:
    """One row per document: id, n_words, hits (stretches of words, last exclusive, disjoint), items (ids as strings, sorted)."""
    spark: SparkSession = documents.sparkSession
    out = documents.select(F.col(id_col), F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_RUNS).alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    blocks = list(_shared_blocks(benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col)), size, block_windows)) or [spark.sparkContext.broadcast([])]
    for tables in blocks:
        out = out.mapInArrow(_pass(tables, schema), schema)
    hits = F.col("hits")
    if len(blocks) > 1:
        # Stretches of several passes may overlap: sorted, then merged.
        def step(acc, x):
            last = F.element_at(acc, -1)
            grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))))
            return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"]), grown).otherwise(F.concat(acc, F.array(x)))

        hits = F.aggregate(F.sort_array("hits"), F.array().cast(_RUNS), step)
    return out.select(id_col, "n_words", hits.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def _shared_blocks(items: DataFrame, size: int, block_windows: int):
    for tables in item_blocks(items, size, block_windows):
        yield items.sparkSession.sparkContext.broadcast(tables)


def _pass(shared, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            found = [x for _, _, texts in C.text_groups(batch.column(1)) for x in search(texts, tables)]
            runs = [a + [{"first": i, "last": j} for i, j in x[1]] for a, x in zip(batch.column(3).to_pylist(), found, strict=True)]
            items = [a + x[2] for a, x in zip(batch.column(4).to_pylist(), found, strict=True)]
            words = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, pa.array(runs, arrow.field(3).type), pa.array(items, arrow.field(4).type)], schema=arrow)

    return run


def hit_words(hits) -> F.Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + (x["last"] - x["first"]))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same rows by plain joins of windows.
OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM pat),
dwin AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM dw, ms, unnest(generate_series(1, len(w) - m + 1)) AS g(i) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, m, item_id FROM dwin JOIN pat USING (m, p)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(generate_series(0, m - 1)) AS g(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
