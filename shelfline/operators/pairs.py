"""Pairs within blocks, whatever a block's size: blocks are cut into tiles whose size is known beforehand.

A block of n rows is dealt by hash over S = ceil(n / tile) strips, and each two strips (i <= j) are a tile of their own, with a
task's worth of rows: all pairs of the block are met once, and no task sees more than two strips of it. Counts come from a
map-side combined aggregate; only blocks of over one strip need theirs. A block of one strip is one tile, its rows aren't copied.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfline.staging import staged

#: Counts of hot blocks are broadcast up to this number of them, else joined.
MOST_BROADCAST = 100_000
#: Pairs that distinct_pairs looks through for a record batch.
MOST_TOLD = 65_536


def hot_blocks(df: DataFrame, block: list[str], tile: int) -> tuple[DataFrame, bool]:
    """(block, _cut) of the blocks that need more than one strip, with their number of strips; whether there are any."""
    hot = staged(df.groupBy(*block).agg(F.count("*").alias("_n")).filter(F.col("_n") > tile).select(*block, F.ceil(F.col("_n") / tile).cast("int").alias("_cut")), "hot-blocks")
    n = hot.count()
    return F.broadcast(hot) if n <= MOST_BROADCAST else hot, n > 0


def _known(df: DataFrame, block: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in block)))


def with_strips(df: DataFrame, block: list[str], tile: int, *by: Column) -> DataFrame:
    """df with _strips, the number of its block's strips, and _strip, the row's own, dealt by a hash of `by`. Rows with a null
    block column are dropped, as they pair with none."""
    known = _known(df, block)
    strips = known.join(hot_blocks(known, block, tile)[0], block, "left").withColumn("_strips", F.coalesce("_cut", F.lit(1))).drop("_cut")
    return strips.withColumn("_strip", F.pmod(F.xxhash64(*by), F.col("_strips")).cast("int"))


def tiles_of(strip: Column, strips: Column) -> Column:
    """(i, j, left, right) of each tile that a strip is in; of its own tile it is both sides."""
    struct = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (i == strip).alias("left"), (j == strip).alias("right"))
    return F.transform(F.sequence(F.lit(0), strips - 1), lambda k: struct(F.least(k, strip), F.greatest(k, strip)))


def blocked_pairs(df: DataFrame, block: list[str], side: str, columns: list[str], tile: int = 4096) -> DataFrame:
    """Distinct pairs within a block whose left side is the smaller; rows with a null block column or side pair with none.

    Rows of blocks of one strip are dealt by block once: both sides of the join read the same exchange, which holds no row
    twice, and the pairs come out of the join as they are met. Only rows of larger blocks are copied, to their tiles.
    """
    cols = [side, *columns]
    rows = _known(staged(df.select(*block, *cols).filter(F.col(side).isNotNull()), "paired"), block)
    hot, any_hot = hot_blocks(rows, block, tile)
    plain = rows.join(hot.select(*block), block, "left_anti") if any_hot else rows
    once = plain.repartition(_tasks(rows), *block).distinct()
    named = lambda n: once.select(*block, *(F.col(c).alias(f"{c}_{n}") for c in cols))
    pairs = named(1).join(named(2), block).filter(F.col(f"{side}_1") < F.col(f"{side}_2"))
    return pairs.unionByName(_tiled_pairs(staged(rows.join(hot.select(*block), block, "left_semi").distinct(), "hot-rows"), block, side, cols, tile)) if any_hot else pairs


def _tasks(rows: DataFrame, most: int = 500_000) -> int:
    """Tasks that rows are dealt to: the session's number, or one for each so many rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def _tiled_pairs(rows: DataFrame, block: list[str], side: str, cols: list[str], tile: int) -> DataFrame:
    """Pairs of distinct rows, a tile at a time."""
    dealt = with_strips(rows, block, tile, *map(F.col, cols)).select(*block, F.struct(*cols).alias("_row"), F.explode(tiles_of(F.col("_strip"), F.col("_strips"))).alias("_t"))
    key = [*block, "_i", "_j"]
    part = lambda which, name: dealt.filter(f"_t.{which}").select(*block, F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"), F.col("_row").alias(name))
    a, b = F.col(f"_a.{side}"), F.col(f"_b.{side}")
    # Tiles are dealt to all tasks, however small their rows are. Of a strip's own tile both orders are met, of two strips' tile one.
    met = part("left", "_a").repartition(_tasks(rows), *key).join(part("right", "_b"), key).filter(F.when(F.col("_i") == F.col("_j"), a < b).otherwise(a != b))
    first, second = F.when(a < b, F.col("_a")).otherwise(F.col("_b")), F.when(a < b, F.col("_b")).otherwise(F.col("_a"))
    pairs = met.select(*block, first.alias("_x"), second.alias("_y"))
    return pairs.select(*block, *(F.col(f"_x.{c}").alias(f"{c}_1") for c in cols), *(F.col(f"_y.{c}").alias(f"{c}_2") for c in cols))


def distinct_pairs(df: DataFrame, block: list[str], each: list[str], side: str, value: str, columns: dict[str, Column] | None = None, tile: int = 2048) -> DataFrame:
    """(block, value_1, value_2) of the values that ever meet, each two told once: rows of one block and one `each` meet,
    value_1's having the smaller side. With `columns`, expressions over block and value, worked out once a value, as name_1 and name_2.

    What is kept doesn't grow with how often two values meet, and no pair is shuffled: a block's values are cut into strips, each
    two strips are a tile, and a task holds a tile's values and one bit for each two of them. Rows stream past in order of
    `each`, as each value's least and largest side. A row is copied only where its block has more values than a strip.
    Rows with a null in block, each, side or value meet none.
    """
    more, keys, place = columns or {}, [*block, *each], [*block, "_i", "_j"]
    rows = staged(_known(df.select(*keys, side, value), [*keys, side, value]), "met")
    values = staged(rows.select(*block, value).distinct(), "values")
    hot, any_hot = hot_blocks(values, block, tile)
    strip, alone = F.pmod(F.xxhash64(value), F.col("_cut")).cast("int"), F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"))
    tiled = lambda x: x.join(hot, block, "left").withColumn("_cut", F.coalesce("_cut", F.lit(1))).withColumn("_t", F.explode(tiles_of(strip, F.col("_cut")))) if any_hot else x.withColumn("_t", alone)
    at = [*block, F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j")]
    kind = dict(rows.dtypes)
    known = tiled(values).select(*at, *(F.lit(None).cast(kind[c]).alias(c) for c in each), value, F.lit(None).cast(kind[side]).alias(side), F.struct(F.col("_t.left").alias("_left"), *(e.alias(c) for c, e in more.items())).alias("_what"))
    seen = tiled(rows).select(*at, *each, value, side, F.lit(None).cast(known.schema["_what"].dataType).alias("_what"))
    dealt = seen.unionByName(known).repartition(_tasks(rows), *place).groupBy(*place, *each, value)
    # A tile's values come before its rows, as their `each` is null.
    stream = dealt.agg(F.min(side).alias("_low"), F.max(side).alias("_high"), F.first("_what", ignorenulls=True).alias("_what")).sortWithinPartitions(*place, *each)
    told = [(f"{c}_{n}", known.schema[value].dataType if c == value else known.schema["_what"].dataType[c].dataType) for n in (1, 2) for c in (value, *more)]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in block), *(T.StructField(c, t) for c, t in told)])
    return stream.mapInArrow(_meetings(block, each, value, to_arrow_schema(schema)), schema)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of keys, as tables of whole runs of equal keys, with where each run begins and the last ends."""
    kept: list[pa.Table] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            kept.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(kept).combine_chunks() if kept else None
        if table is None or not len(table):
            continue
        codes = [table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy() for k in keys]
        begins = np.concatenate([[0], 1 + np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in codes))), [len(table)]])
        if batch is not None:  # the last run may go on
            kept, table, begins = [table.slice(begins[-2])], table.slice(0, begins[-2]), begins[:-1]
        if len(table):
            yield table, begins


class _Tile:
    """A tile's values with what else is told of them, and which of them have met: of one strip all by all, of two each by the other."""

    def __init__(self, rows: pa.Table, block: list[str], value: str):
        what = rows.column("_what").combine_chunks()
        left, *more = what.flatten()
        self.block = [rows.column(c)[0].as_py() for c in block]
        self.told = [rows.column(value).combine_chunks(), *more]
        self.code = {v: i for i, v in enumerate(self.told[0].to_pylist())}
        self.own = rows.column("_i")[0].as_py() == rows.column("_j")[0].as_py()
        self.left = left.to_numpy(zero_copy_only=False).astype(bool)
        first, second = np.flatnonzero(self.left), np.flatnonzero(~self.left)
        sides = [(np.arange(len(self.left)),) * 2] if self.own else [(first, second), (second, first)]
        self.met = [(a, b, np.zeros((len(a), len(b)), bool)) for a, b in sides]
        self.at = np.empty(len(self.left), np.int64)  # a value's place on its side
        for side in (first, second):
            self.at[side] = np.arange(len(side))
        if self.own:
            self.at = np.arange(len(self.left))

    def meet(self, values: list, low: np.ndarray, high: np.ndarray) -> None:
        codes = np.array([self.code[v] for v in values])
        left = self.left[codes]
        sides = [(slice(None), slice(None))] if self.own else [(left, ~left), (~left, left)]
        for (a, b), (_, _, met) in zip(sides, self.met):
            met[np.ix_(self.at[codes[a]], self.at[codes[b]])] |= low[a][:, None] < high[b][None, :]

    def pairs(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a, b, met in self.met:
            step = max(1, MOST_TOLD // max(1, len(b)))
            for r in range(0, len(a), step):
                x, y = np.nonzero(met[r : r + step])
                if len(x):
                    head = [pa.array([v] * len(x), out.field(i).type) for i, v in enumerate(self.block)]
                    sides = [c.take(pa.array(k)) for k in (a[r + x], b[y]) for c in self.told]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*head, *sides], out)], schema=out)


def _meetings(block: list[str], each: list[str], value: str, out: pa.Schema):
    def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for table, begins in _runs(batches, [*block, "_i", "_j", *each]):
            n, values, begun = len(table), table.column(value).to_pylist(), table.column("_what").is_valid().to_numpy()
            order = pc.rank(pa.concat_arrays([c.combine_chunks() for c in (table.column("_low"), table.column("_high"))]), tiebreaker="dense").to_numpy()
            low, high = order[:n].astype(np.int64), order[n:].astype(np.int64)
            for i, j in zip(begins[:-1], begins[1:]):
                if begun[i]:
                    if tile:
                        yield from tile.pairs(out)
                    tile = _Tile(table.slice(i, j - i), block, value)
                else:
                    tile.meet(values[i:j], low[i:j], high[i:j])
        if tile:
            yield from tile.pairs(out)

    return meetings


def _matrix(vectors: pa.ListArray, size: int) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(size, -1) if size else np.zeros((0, 0))
    length = np.sqrt((flat * flat).sum(1, keepdims=True))
    return flat / np.where(length > 0, length, 1)


def scored_pairs(df: DataFrame, block: list[str], id_col: str, vector: str, least: float | None = None, tile: int = 512, earlier: str | None = None) -> DataFrame:
    """(block, id_1 < id_2, cosine) of all pairs within a block, or of those whose cosine reaches `least`: each tile is
    one matrix product. Cosines are kept within 0 and 1; rows with a null id, or a null or empty vector, pair with none. Ids are unique.

    `earlier` names an array of the keys by which a row stands in several blocks, where the first block column is the
    key's place: a pair is told in the first block that both are in. See lsh_pairs.
    """
    # Floats are made doubles by the task, not before rows are copied to their tiles.
    floats = dict(df.select(vector).dtypes)[vector] == "array<float>"
    rows = df.select(*block, F.col(id_col).alias("_id"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("_v"), *([F.col(earlier).alias("_keys")] if earlier else [])).filter(F.col("_id").isNotNull() & (F.size("_v") > 0))
    cut = with_strips(rows, block, tile, F.col("_id"))
    dealt = cut.withColumn("_t", F.explode(tiles_of(F.col("_strip"), F.col("_strips")))).select(*block, F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"), F.col("_t.left").alias("_left"), F.col("_t.right").alias("_right"), "_id", "_v", *(["_keys"] if earlier else []))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(c, kind[c]) for c in block] + [T.StructField(c, kind["_id"]) for c in ("id_1", "id_2")] + [T.StructField("cosine", T.DoubleType())])
    arrow, n = to_arrow_schema(schema), len(block)

    def product(tile: pa.Table) -> pa.Table:
        side = [tile.filter(tile.column(c)).combine_chunks() for c in ("_left", "_right")]
        ids = [s.column("_id").to_numpy() for s in side]
        a, b = (_matrix(s.column("_v").combine_chunks(), len(s)) for s in side)
        if not len(a) or not len(b) or a.shape[1] != b.shape[1]:
            return arrow.empty_table()
        cos = np.clip(a @ b.T, 0.0, 1.0)
        own = tile.column("_i")[0].as_py() == tile.column("_j")[0].as_py()
        wanted = (ids[0][:, None] < ids[1][None, :]) if own else (ids[0][:, None] != ids[1][None, :])
        if least is not None:
            wanted &= cos >= least
        if earlier:
            # Of the blocks that hold both rows only the first one tells their pair.
            x, y = (np.array(s.column("_keys").to_pylist()) for s in side)
            at = tile.column(block[0])[0].as_py()
            for k in range(at):
                wanted &= x[:, k][:, None] != y[:, k][None, :]
        i, j = np.nonzero(wanted)
        p, q = ids[0][i], ids[1][j]
        turned = p > q
        head = [pa.array([tile.column(c)[0].as_py()] * len(i), arrow.field(c).type) for c in block]
        one, two = np.where(turned, q, p), np.where(turned, p, q)
        return pa.Table.from_arrays([*head, pa.array(one, arrow.field(n).type), pa.array(two, arrow.field(n + 1).type), pa.array(cos[i, j])], schema=arrow)

    return dealt.groupBy(*block, "_i", "_j").applyInArrow(product, schema)


def hyperplane_keys(vector: Column, dims: int, tables: int, bits: int, seed: int) -> Column:
    """For each table one number: on which sides of `bits` random hyperplanes the vector lies."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dims))

    def keys(vectors: pd.Series) -> pd.Series:
        sides = np.stack(vectors.to_numpy()).astype(np.float64) @ planes.T > 0 if len(vectors) else np.zeros((0, tables * bits), bool)
        return pd.Series(list((sides.reshape(-1, tables, bits) * (1 << np.arange(bits))).sum(2).astype(np.int64)))

    return F.pandas_udf(keys, "array<long>")(vector)


def lsh_pairs(df: DataFrame, id_col: str, vector: str, dims: int, least: float = 0.9, tables: int = 24, bits: int = 12, seed: int = 5, tile: int = 512) -> DataFrame:
    """(id_1 < id_2, cosine) of pairs with a cosine of at least `least`: those that share a bucket of random hyperplanes in one
    of the tables, each told once, with its exact cosine. A pair of cosine c shares a table's bucket with probability
    (1 - acos(c) / pi) ** bits, so that tables and bits set the recall: 24 tables of 12 bits find 98 of 100 pairs of cosine
    0.9. For when blocks by columns aren't known and all pairs are too many. Vectors must have `dims` numbers; others pair with none.
    """
    rows = df.filter(F.size(vector) == dims).select(F.col(id_col).alias("_lid"), F.col(vector).alias("_lv"))
    keyed = staged(rows.withColumn("_keys", hyperplane_keys(F.col("_lv"), dims, tables, bits, seed)), "lsh-keys")
    buckets = keyed.select("_lid", "_lv", "_keys", F.posexplode("_keys").alias("_table", "_bucket"))
    return scored_pairs(buckets, ["_table", "_bucket"], "_lid", "_lv", least, tile, "_keys").select("id_1", "id_2", "cosine")
