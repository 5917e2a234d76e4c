"""Exact joins of documents by the Jaccard similarity of their word n-gram sets, and the groups such links make.

The method is a blocked sparse product of the document by n-gram incidence matrix with its transpose:

* rows are distinct n-gram sets (documents with equal sets are one row), columns are 64-bit hashes of n-grams; the chance
  that two of a corpus's n-grams share a hash is about n^2 / 2^62;
* columns have one order everywhere: by how many texts hold them, then by hash. The counts come from a sketch of 2^21
  counters over all texts, which tasks fill and blocks add up; counts that collide only make the order worse;
* two sets of sizes m and n link only if they share `least(m, n)` columns. So the first l of the columns they share stand
  among the first n - least + l of either: only these columns of a set make entries (a quarter of it, and some for l);
* the product's overlap counts are added up over these columns, and a pair of fewer than l, which grows with the smaller
  size, is discarded; in columns beyond those places a pair needn't meet at all;
* copies in a group never make all their pairs: only sets of different groups meet, and groups are found first:
  in each column, sets meet a pivot, drawn by a hash of one of `pivots` kinds; each set goes on with the `tries` pivots that
  it meets most, and those found similar are united. Then sets meet a few neighbours in an order drawn by a hash, in runs
  of about `block` sets of a column, round by round while these find a tenth of the links that the round before found. In
  the product, columns are taken in blocks of `block` sets; a column of more is dropped if its sets are all of one group, and a group of more has blocks that don't meet;
* in columns of many sets a pair counts only if parities of its sets in 256 counters don't tell it apart;
* a pair goes on if bitmaps of its sets (2 to 4 bits for each n-gram) leave the bound in reach, and is confirmed on the
  whole sets.

No cap drops a pair. A column that very many sets share is dealt to tasks in parts. Whole sets are recomputed from the
texts that are asked for, rather than shuffled.

Defined results: null, empty and wordless texts have an empty set (n_shingles 0) and are linked with nothing; a text of
fewer than `width` words is one n-gram; repeated ids are separate rows, in one group if their sets are linked, and each
group's id is its smallest document id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm import common as C
from shelfline.operators.graph import connected_components

#: Counters of the sketch that orders columns, as a power of two, and how many go in one row.
SKETCH_BITS, _BLOCK_BITS = 21, 15
#: Entries of one column that go to one task: a column of more, by its sketch, is dealt in parts.
HOT = 20_000
_PARITY = ("p0", "p1", "p2", "p3")
#: Bytes of text whose n-grams are worked out at once: some thirty times as many are held meanwhile, and workers keep them.
PIECE = 1 << 20
#: Asked sets up to which their ids are broadcast, and up to which a bitmap of eight bits for each stands in for them.
FEW_IDS, BITMAP_IDS = 300_000, 1 << 24


def text_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of each text's distinct n-grams, by text, then hash."""
    buf, begins = C.joined(texts)
    starts, ends = C.word_bounds(buf, C.SPACED)
    h = C.word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, begins)
    count = np.diff(first)
    n = len(h)
    grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if n >= width:
        grams = C.combine([h[k : n - width + 1 + k] for k in range(width)])
        owner = np.repeat(np.arange(len(texts)), count)
        inside = owner[: n - width + 1] == owner[width - 1 :]
        grams, owner = grams[inside], owner[: n - width + 1][inside]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.array([C.combine([h[i : i + 1] for i in range(first[d], first[d + 1])])[0] ^ C.mix(np.array([count[d]], np.uint64))[0] for d in few], np.uint64)
        grams, owner = np.concatenate((grams, short)), np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], owner[keep]


def set_ids(grams: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its set's size and a 64-bit id of the set (0 if empty)."""
    size = np.bincount(owner, minlength=n_texts)
    begin = np.cumsum(size) - size
    place = np.arange(len(grams), dtype=np.uint64) - begin[owner].astype(np.uint64)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(C.mix(grams + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64, out=sums[1:])
    ids = C.mix(sums[begin + size] - sums[begin] + size.astype(np.uint64))
    ids[size == 0] = 0
    return size, ids


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _over_texts(documents: DataFrame, id_col: str, text_col: str, width: int, schema: str, start) -> DataFrame:
    """mapInArrow over (id, text). start() gives each task emit(ids, n_texts, grams, owner), which returns a batch, and
    finish(), which yields the task's last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, finish = start()
        for batch in batches:
            for at, to, texts in C.text_groups(batch.column(1), PIECE):
                yield emit(batch.column(0).slice(at, to - at), len(texts), *text_sets(texts, width))
        yield from finish()

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bit_sets(grams: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """For each text a bitmap of its set as 64-bit words: 2 to 4 bits for each n-gram, a power of two in all."""
    width = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64), 0)
    begin = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), bool)
    bits[begin[owner] + (grams & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    words = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((np.append(begin, width.sum()) // 64).astype(np.int32)), pa.array(words))


def parities(grams: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Four 64-bit words for each text: of 256 counters, whether an odd number of its n-grams fall there. As many bits as
    two texts differ in, so many n-grams at least does only one of them have."""
    at = owner * 256 + (grams & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(at, minlength=256 * n_texts) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n_texts, 4)


def slots(grams: np.ndarray) -> np.ndarray:
    """Each n-gram's counter of the sketch."""
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signatures(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, sid, bits, p0 to p3) of each document, and for each task the rows (block, counts) of its part of the sketch."""
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", "n", "sid", "bits", *_PARITY, "block", "counts"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4]

    def start():
        sketch, id_type = np.zeros(1 << SKETCH_BITS, np.int64), []

        def emit(ids, n, grams, owner):
            np.add(sketch, np.bincount(slots(grams), minlength=len(sketch)), out=sketch)
            id_type[:] = [ids.type]
            size, sid = set_ids(grams, owner, n)
            return pa.RecordBatch.from_arrays([ids, pa.array(size), _signed(sid), bit_sets(grams, owner, size), *map(pa.array, parities(grams, owner, n).T), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)

        def finish():
            if id_type and sketch.any():
                own = sketch.reshape(-1, 1 << _BLOCK_BITS)
                at = np.flatnonzero(own.any(1))
                told = [own[b].astype(np.uint8 if own[b].max() < 256 else np.int64).tobytes() for b in at]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), t) for t in (id_type[0], *types)] + [pa.array(at.astype(np.int32)), pa.array(told, pa.binary())], names)

        return emit, finish

    return _over_texts(documents, id_col, text_col, width, f"id {kind}, n long, sid long, bits array<long>, {', '.join(f'{p} long' for p in _PARITY)}, block int, counts binary", start)


def column_counts(sigs: DataFrame) -> np.ndarray:
    """The sketch: in how many texts the n-grams of each counter stand. Tasks' parts are added up block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_buffer()
                found = np.frombuffer(raw, np.uint8 if raw.size == 1 << _BLOCK_BITS else np.int64)
                sums[b] = sums[b] + found if b in sums else found.astype(np.int64)
        for b, found in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": pa.array([np.minimum(found, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    out = np.zeros((1 << (SKETCH_BITS - _BLOCK_BITS), 1 << _BLOCK_BITS), np.int32)
    summed = sigs.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary")
    told = summed.toArrow()  # as many rows as blocks, 8 MB at most, by one job: an iterator has one for each partition
    for b, raw in zip(told.column(0).to_pylist(), told.column(1), strict=True):
        out[b] = np.frombuffer(raw.as_buffer(), np.int32)
    return out.ravel()


def extension(size):
    """How many columns beyond the first that could be shared a set of so many enters, itself included."""
    return 1 + size // 32


def entries(documents: DataFrame, width: int, percent: int, sketch, id_col: str, text_col: str, hot: int) -> DataFrame:
    """(h, part, sid, n, place): each set's first columns in the common order; part is -1 but in hot columns."""

    def start():
        counts = sketch.value

        def emit(ids, n_texts, grams, owner):
            size, sid = set_ids(grams, owner, n_texts)
            _, one = np.unique(sid, return_index=True)  # copies within the batch
            chosen = np.zeros(n_texts, bool)
            chosen[one] = True
            keep = chosen[owner]
            grams, owner = grams[keep], owner[keep]
            size = np.where(chosen, size, 0)
            often = counts[slots(grams)].astype(np.int64)
            # N-grams come by text and hash; now by text, count and hash.
            order = np.argsort(owner << 32 | often, kind="stable")
            grams, owner, often = grams[order], owner[order], often[order]
            place = np.arange(len(grams)) - (np.cumsum(size) - size)[owner]
            first = size - -(-percent * size // 100) + extension(size)
            keep = place < first[owner]
            grams, owner, often, place = grams[keep], owner[keep], often[keep], place[keep]
            parts = often // hot + 1
            part = np.where(parts > 1, (C.mix(sid[owner]) % parts.astype(np.uint64)).astype(np.int64), -1)
            return pa.RecordBatch.from_pydict({"h": _signed(grams), "part": pa.array(part.astype(np.int32)), "sid": _signed(sid[owner]), "n": pa.array(size[owner].astype(np.int32)), "place": pa.array(place.astype(np.int32))})

        return emit, lambda: ()

    return _over_texts(documents, id_col, text_col, width, "h long, part int, sid long, n int, place int", start)


def shared_entries(found: DataFrame, pivots: int) -> DataFrame:
    """Entries of columns that two or more sets share, each once, with the column's pivot (p_sid, p_n, p_place).

    The pivot is the set that comes first by a hash that each of `pivots` kinds of column draws anew, in half of the kinds
    after the number of columns before this one. A hot column's parts
    have pivots of their own, and all their entries stay.
    """
    names = ["h", "sid", "n", "place", "p_sid", "p_n", "p_place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by column and part, pivots first. A column may go on in the next batch: its last row and pivot are kept.
        last, pivot, given = None, None, False
        for batch in batches:
            h, part, *t = (batch.column(i).to_numpy() for i in range(5))
            if not len(h):
                continue
            if last is not None:
                h, part, *t = (np.concatenate((x, y)) for x, y in zip(last, (h, part, *t), strict=True))
            same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
            new = np.ones(len(h), bool)
            new[1:] = ~same | (t[0][1:] != t[0][:-1])
            h, part, *t = (x[new] for x in (h, part, *t))
            same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
            start = np.concatenate(([0], np.flatnonzero(~same) + 1))
            of_run = np.repeat(start, np.diff(np.append(start, len(h))))
            p = [x[of_run] for x in t]
            if pivot is not None:
                for x, v in zip(p, pivot, strict=True):
                    x[of_run == 0] = v
            out = part >= 0
            out[1:] |= same
            out[:-1] |= same
            kept = bool(out[-1]) or (len(out) == 1 and given)
            if given:
                out[0] = False
            given = kept
            last, pivot = [x[-1:] for x in (h, part, *t)], [x[-1] for x in p]
            yield pa.RecordBatch.from_pydict({c: pa.array(x[out]) for c, x in zip(names, [h, *t, *p], strict=True)})

    kind = F.pmod("h", F.lit(pivots))
    drawn = F.xxhash64("sid", kind)
    # Of every other kind the set that has the fewest rarer columns: of near copies, the one nearest to what they share.
    order = F.when(kind % 2 == 0, F.shiftleft(F.col("place").cast("long"), 40) + F.shiftrightunsigned(drawn, 24)).otherwise(drawn)
    dealt = found.repartition("h", "part").sortWithinPartitions("h", "part", order, "sid")
    return dealt.mapInArrow(run, "h long, sid long, n int, place int, p_sid long, p_n int, p_place int")


def least_common(m, n, percent: int):
    """How many n-grams sets of sizes m and n share at least if they link, as columns."""
    return F.ceil(percent * (m.cast("long") + n) / (100 + percent))


def _asked_texts(documents: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the documents asked for by id, and maybe some more: by broadcast ids if few, by a bitmap of their hashes
    (bounded by eight bits for each of BITMAP_IDS), else by a shuffle."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count = asked.count()
    if not FEW_IDS < count <= BITMAP_IDS:
        return docs.join(F.broadcast(asked) if count <= FEW_IDS else asked, "id", "left_semi").select("text")
    size = max(6, (8 * count - 1).bit_length())
    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - size)
    words = asked.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (size - 6), np.int64)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for batch in batches:
            b = batch.column(1).to_numpy()
            keep = (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(["text"]).filter(pa.array(keep.astype(bool)))

    return docs.select("text", bit.alias("bit")).mapInArrow(wanted, "text string")


def whole_sets(documents: DataFrame, pairs: DataFrame, firsts: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(sid, grams) of the sets in pairs, from one document of each: `firsts` has (sid, id)."""
    asked = C.staged(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(firsts.select("sid", "id"), "sid").select("id"), "asked")

    def start():
        def emit(ids, n, grams, owner):
            size, sid = set_ids(grams, owner, n)
            _, one = np.unique(sid, return_index=True)
            ends = np.cumsum(size)
            full = [grams[ends[i] - size[i] : ends[i]].view(np.int64) for i in one.tolist()]
            return pa.RecordBatch.from_pydict({"sid": _signed(sid[one]), "grams": pa.array(full, pa.list_(pa.int64()))})

        return emit, lambda: ()

    texts = _asked_texts(documents, asked, id_col, text_col).select(F.lit(0).alias("id"), "text")
    return _over_texts(texts, "id", "text", width, "sid long, grams array<long>", start)


def possible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave the bound in reach: a bit that only one set has is an n-gram that only it has."""
    one = lambda name, tag: firsts.select(F.col("sid").alias(name), F.col("n").alias(f"n{tag}"), F.col("bits").alias(f"x{tag}"))
    both = pairs.join(one("a", 0), "a").join(one("b", 1), "b")

    def halved(x, other):
        # Sizes within the bound differ by one power of two at most; the larger bitmap is folded.
        half = F.greatest(F.size(other), F.lit(1))
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(x)

    both = both.select("a", "b", "n0", "n1", halved(F.col("x0"), F.col("x1")).alias("x0"), halved(F.col("x1"), F.col("x0")).alias("x1"))
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)
    most = F.least(F.col("n0") - only("x0", "x1"), F.col("n1") - only("x1", "x0"))
    return both.filter(most >= least_common(F.col("n0"), F.col("n1"), percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the bound."""
    # Both joins are plain: Spark splits a partition in which one set has many pairs.
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def pivot_pairs(shared: DataFrame, percent: int, tries: int) -> DataFrame:
    """(a, b) of each set and the pivots that it meets in most columns."""
    least = least_common(F.col("n"), F.col("p_n"), percent)
    within = (F.col("place") <= F.col("n") - least) & (F.col("p_place") <= F.col("p_n") - least)
    met = shared.filter((F.col("sid") != F.col("p_sid")) & within).groupBy("sid", F.col("p_sid").alias("pivot")).agg(F.count("*").alias("c"))
    best = met.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "pivot")), asc=False), 1, tries).alias("best"))  # no more pivots than columns of one set
    pairs = best.select("sid", F.explode("best.pivot").alias("pivot"))
    return pairs.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _named(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries with their groups."""
    own = [c for c in ("h", "sid", "n", "place", *_PARITY) if c in shared.columns]
    return shared.select(*own).join(groups, F.col("sid") == F.col("node"), "left").select(*own, F.coalesce("root", "sid").alias("g"))


def column_sizes(shared: DataFrame, most: int) -> DataFrame:
    """(h, size) of columns of more than `most` sets: they are few, as they share the entries."""
    return C.staged(shared.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > most), "large-columns")


def _large_columns(shared: DataFrame, block: int, sizes: DataFrame | None = None) -> DataFrame | None:
    """(h, size) of columns of more than `block` sets, None without any; sizes has them, and maybe smaller ones, if they are counted."""
    large = (column_sizes(shared, block) if sizes is None else sizes).filter(F.col("size") > block)
    count = large.count()
    return (F.broadcast(large) if count <= 200_000 else large) if count else None


def _block_plan(rows: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(h, whole, of, first, own_blocks, blocks): how the large columns are cut.

    A group of more than `block` sets of a column has blocks of its own (whole, of = group); all others share the rest. A
    column of one group has no blocks, as no pair in it can add a link. Sets are counted within tasks before they meet.
    """
    counts = C.staged(rows.join(large, "h").groupBy("h", "g").agg(F.count("*").alias("c")), "column-groups")
    mixed = counts.groupBy("h").agg((F.min("g") < F.max("g")).alias("mixed"))
    whole = F.col("c") > block
    parts = counts.groupBy("h", whole.alias("whole"), F.when(whole, F.col("g")).otherwise(0).alias("of")).agg(F.sum("c").alias("c"))
    by_column = Window.partitionBy("h")
    parts = parts.join(mixed, "h").withColumn("own_blocks", F.when(F.col("mixed"), F.ceil(F.col("c") / block)).otherwise(0).cast("int"))
    before = F.sum("own_blocks").over(by_column.orderBy("whole", "of").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("own_blocks")
    return C.staged(parts.select("h", "whole", "of", before.cast("int").alias("first"), "own_blocks", F.sum("own_blocks").over(by_column).cast("int").alias("blocks")), "blocks")


def _dealt(rows: DataFrame, large: DataFrame | None, block: int) -> DataFrame:
    """Entries with the blocks (i, j) in which they meet entries of other groups, and the block of their own."""
    if large is None:
        return rows.select("h", *(F.lit(0).alias(c) for c in ("i", "j", "own")), *(c for c in rows.columns if c != "h"))
    plan = _block_plan(rows, large, block)
    sized = F.broadcast if plan.count() <= 200_000 else (lambda df: df)
    wholes = plan.filter("whole").select("h", F.col("of").alias("g"), F.lit(True).alias("alone"))
    rows = rows.join(sized(wholes), ["h", "g"], "left").withColumn("whole", F.coalesce("alone", F.lit(False))).withColumn("of", F.when(F.col("whole"), F.col("g")).otherwise(0))
    rows = rows.join(sized(plan), ["h", "whole", "of"], "left").fillna({"first": 0, "own_blocks": 1, "blocks": 1}).filter("blocks > 0")
    own = (F.col("first") + F.pmod(F.xxhash64("sid", F.lit(7)), F.col("own_blocks"))).cast("int")
    # A set of block k meets blocks k to last as the first part, and blocks 0 to k as the second; none of its own group alone.
    met = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: ~F.col("whole") | (j < F.col("first")) | (j >= F.col("first") + F.col("own_blocks")))
    k = F.explode(F.transform(met, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), own.alias("own"))))
    own_columns = [c for c in ("sid", "n", "place", "g", *_PARITY) if c in rows.columns]
    return rows.select("h", *own_columns, k.alias("k")).select("h", "k.i", "k.j", "k.own", *own_columns)


def _meetings(rows: DataFrame, percent: int, reach: int | None) -> DataFrame:
    """(a, b, c) of sets of different groups that meet within the bounds in a run of equal (h, i, j), c times in all.

    Rows come dealt and sorted. With reach, a set meets only those at most so many rows on; without, rows of a run come by
    group, and a set meets all those of later groups: then c counts all columns that the two share among their first
    n - least + l, of which linked sets share l = extension(the smaller size) at least, and pairs of fewer are discarded.
    Where rows have parities (0 where they have none), pairs that these tell apart don't count.
    """

    names = "ablc" if reach is None else "abc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def added_up() -> pa.RecordBatch:
            a, b, l, c = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b, l, c = a[order], b[order], l[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            held[:] = [(a[first], b[first], l[first], np.add.reduceat(c, first))]
            out = dict(zip("ablc", map(pa.array, held[0]), strict=True))
            return pa.RecordBatch.from_pydict({x: out[x] for x in names})

        size = 0
        for t in _whole_runs(batches):
            new = np.any([t[c][1:] != t[c][:-1] for c in ("h", "i", "j")], axis=0)
            ends = lambda new: np.repeat(e := np.append(np.flatnonzero(new) + 1, len(t["h"])), np.diff(np.concatenate(([0], e))))  # noqa: E731, B023
            end = ends(new)
            n, spare = t["n"].astype(np.int64), t["n"] - t["place"]
            left = np.arange(len(end))
            after = left + 1 if reach is not None else ends(new | (t["g"][1:] != t["g"][:-1]))
            d = 0
            while (reach is None or d < reach) and len(left := left[after[left] + d < end[left]]):
                p, q = left, after[left] + d
                l = extension(np.minimum(n[p], n[q])) if reach is None else np.ones(len(p), np.int64)
                short = -(-percent * (n[p] + n[q]) // (100 + percent)) - l  # in which they may share all but l
                ok = (spare[p] > short) & (spare[q] > short) & (t["g"][p] != t["g"][q]) & ((t["i"][p] == t["j"][p]) | (t["own"][p] != t["own"][q]))
                if "p0" in t:
                    near = np.flatnonzero(ok)
                    odd = sum(np.bitwise_count(t[x][p[near]] ^ t[x][q[near]]).astype(np.int64) for x in _PARITY)
                    ok[near] = odd <= n[p[near]] + n[q[near]] - 2 * (short + l)[near]
                if ok.any():
                    held.append((t["sid"][p[ok]], t["sid"][q[ok]], l[ok], np.ones(int(ok.sum()), np.int64)))
                    size += len(held[-1][0])
                if size > 1_000_000:
                    out = added_up()
                    size = len(held[0][0])
                    if size > 500_000:
                        yield out
                        held, size = [], 0
                d += 1
        if held:
            yield added_up()

    met = rows.mapInArrow(run, ", ".join(f"{x} long" for x in names)).groupBy("a", "b")
    if reach is not None:
        return met.agg(F.sum("c").alias("c"))
    return met.agg(F.sum("c").alias("c"), F.max("l").alias("l")).filter("c >= l").select("a", "b", "c")


def _lined_up(rows: DataFrame, large: DataFrame | None, kinds: int, block: int, seed: int) -> DataFrame:
    """Entries in an order that a hash of one of `kinds` draws; a large column is cut into runs of about `block` entries."""
    order = F.xxhash64("sid", F.pmod("h", F.lit(kinds)), F.lit(seed))
    runs = F.lit(1) if large is None else F.coalesce(F.ceil(F.col("size") / block), F.lit(1))
    rows = (rows if large is None else rows.join(large, "h", "left")).withColumn("o", order)
    # Runs are ranges of the order: of its 32 high bits, from 0 up.
    i = F.shiftright((F.shiftright("o", 32) + F.lit(1 << 31)) * runs, 32).cast("int")
    rows = rows.select("h", i.alias("i"), i.alias("j"), i.alias("own"), "sid", "n", "place", "g", "o")
    return rows.repartition("h", "i").sortWithinPartitions("h", "i", "o").drop("o")


def neighbour_pairs(shared: DataFrame, groups: DataFrame, percent: int, kinds: int, reach: int, tries: int, block: int, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b): in an order that a hash of one of `kinds` draws, each set meets the next `reach` of its column's run; it
    goes on with the `tries` sets of other groups that it meets most."""
    met = _meetings(_lined_up(_named(shared, groups), _large_columns(shared, block, sizes), kinds, block, seed), percent, reach)
    both = met.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "c").select("p.x", "p.y", "c")
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("c"), "y"))).filter(F.col("r") <= tries)
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def crossing_pairs(shared: DataFrame, groups: DataFrame, percent: int, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b) of all sets of different groups that meet in a column where a linked pair could meet first."""
    rows = _dealt(_named(shared, groups), _large_columns(shared, block, sizes), block)
    return _meetings(rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "g"), percent, None).select("a", "b")


def with_parities(shared: DataFrame, dense: DataFrame, columns: DataFrame, firsts: DataFrame) -> DataFrame:
    """Entries with their sets' parities where columns are dense, else with zeros: there meet few pairs."""
    told = dense.join(firsts.select("sid", *_PARITY), "sid").select("h", "sid", "n", "place", *_PARITY)
    rest = shared.join(columns.select("h"), "h", "left_anti").select("h", "sid", "n", "place")
    return told.unionByName(rest.select("*", *(F.lit(0).cast("long").alias(p) for p in _PARITY)))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by (h, i, j) in pieces that cut no run; a run has about two blocks of sets at most."""
    held = None
    for batch in batches:
        t = {c: batch.column(k).to_numpy() for k, c in enumerate(batch.schema.names)}
        if not len(t["h"]):
            continue
        if held is not None:
            t = {c: np.concatenate((held[c], t[c])) for c in t}
        edge = np.flatnonzero((t["h"][1:] != t["h"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])) + 1
        cut = int(edge[-1]) if len(edge) else 0
        if cut:
            yield {c: v[:cut] for c, v in t.items()}
        held = {c: v[cut:] for c, v in t.items()}
    if held is not None:
        yield held


def similar_groups(documents: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", pivots: int = 16, tries: int = 2, reach: int = 8, block: int = 2000, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id of all documents that links reach)."""
    spark = documents.sparkSession
    told = C.staged(signatures(documents, width, id_col, text_col), "signatures")
    sigs = told.filter("block IS NULL")
    sketch = spark.sparkContext.broadcast(column_counts(told))
    shared = C.staged(shared_entries(entries(documents, width, percent, sketch, id_col, text_col, hot), pivots), "entries")
    sketch.destroy()
    firsts = C.staged(sigs.filter("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), *(F.first(p).alias(p) for p in _PARITY)), "sets")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = C.staged(possible(pairs, firsts, percent), f"{name}-pairs")
        sets = whole_sets(documents, pairs, firsts, width, id_col, text_col)
        return C.staged(confirmed(pairs, sets, percent), name)

    def united(groups: DataFrame, more: DataFrame) -> DataFrame:
        # Groups so far are stars around their roots.
        return C.staged(connected_components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b"), "groups")

    near = links(pivot_pairs(shared, percent, tries), "pivot-links")
    groups = C.staged(connected_components(near, "a", "b"), "groups")
    # Columns of no more sets than `reach` need no neighbours: their pairs are few.
    told = shared.select("h", "sid", "n", "place")
    sizes = column_sizes(shared, min(reach, block))
    if (columns := _large_columns(shared, reach, sizes)) is not None:
        dense = C.staged(told.join(columns.select("h"), "h", "left_semi"), "dense-entries")
        before, seed = near.count(), 0
        while before:
            more = links(neighbour_pairs(dense, groups, percent, 4, reach, 2 * tries, block, seed, sizes), "neighbour-links")
            if found := more.count():
                groups = united(groups, more)
            before, seed = found if 10 * found > before else 0, seed + 1
        told = with_parities(told, dense, columns, firsts)
    more = links(crossing_pairs(told, groups, percent, block, sizes), "crossing-links")
    if not more.isEmpty():
        groups = united(groups, more)
    # Only ids are joined: groups are over sets, and each set's smallest id stands for its copies.
    by_set = firsts.select("sid", "id").join(groups, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("g"), "id")
    least = by_set.groupBy("g").agg(F.min("id").alias("component_id"))
    named = by_set.join(least, "g").select("sid", "component_id")
    joined = sigs.join(named, "sid", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(C.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(root) AS component_id FROM r GROUP BY v) m USING (doc_id)
"""
