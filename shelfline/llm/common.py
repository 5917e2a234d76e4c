"""Helpers that the corpus operators share: paths, staged tables, fixed splits and byte-level words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.staging import new_path, staged  # noqa: F401 (for the operators)

#: ASCII white space as the contracts define it: blank, \t, \n, \v, \f, \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Java pattern of a run of such white space.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Bytes that upper-case letters A-Z turn into; all others stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n: the contracts' fixed folds."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def first_rows(rows: DataFrame, size: Column, most: int, *order: str) -> DataFrame:
    """Of a bounded sample, which `order` tells apart, the rows in order whose sizes add up to `most` at most, but one row in any
    case. Only orders and sizes meet in one task; what rows hold is written by the tasks that make it."""
    kept = staged(rows.withColumn("_size", size), "sample")
    before = F.coalesce(F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = kept.select(*order, "_size", before.alias("_before"))
    first = sums.filter(F.col("_before") + F.col("_size") <= F.greatest(F.lit(most), F.when(F.col("_before") == 0, F.col("_size")))).select(*order)
    return kept.join(F.broadcast(first), list(order)).drop("_size").orderBy(*order)


def text_groups(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (first, last, UTF-8 texts) of a column, each of about `most` bytes or one text; null is empty.

    Slices are cut by the column's own offsets, so that only one slice's texts are Python objects at a time. Batches
    themselves are bounded by Spark (spark.sql.execution.arrow.maxBytesPerBatch)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = min(len(ends), int(np.searchsorted(ends, before + most)) + 1)
        yield first, last, [v or b"" for v in texts.slice(first, last - first).cast(pa.binary()).to_pylist()]
        first = last


def byte_class(not_word: bytes) -> np.ndarray:
    """True for each byte that belongs to words."""
    out = np.ones(256, bool)
    out[np.frombuffer(not_word, np.uint8)] = False
    return out


SPACED = byte_class(SPACES)


def joined(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, a line end after each, and where each begins."""
    raw = b"\n".join(texts) + b"\n"
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    return np.frombuffer(raw.translate(LOWER) if lower else raw, np.uint8), begins


def word_bounds(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of word bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = is_word[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# A word's hash is a polynomial over a random value for each byte, taken from prefix sums modulo 2**64, then mixed.
_CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and 3 modulo 4
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        n = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _tables[name] = np.cumprod(step, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they stand."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + _CHUNK, "right")))
        at, to = int(begins[i]), int(ends[j - 1])
        up, down = _powers(to - at + 1)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_BYTES[buf[at:to]] * up[: to - at], dtype=np.uint64, out=sums[1:])
        b, e = begins[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return out


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes, position by position."""
    out = np.zeros(len(parts[0]), np.uint64)
    for k, p in enumerate(parts):
        out = (out + p) * np.uint64(0x2545F4914F6CDD1D + 2 * k)
    return mix(out)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, even where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]
