"""Graph operators: connected components whose root is the smallest node, and ids made from roots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType, StructField, StructType

from shelfline.staging import staged


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """edges joined with (u, m, d) by u. Nodes of more than `most` edges are broadcast, so that no node's edges meet in one
    task: there are at most 2 * edges / most of them."""
    heavy = least.filter(F.col("d") > most).select("u", F.col("m").alias("hm"))
    light = least.filter(F.col("d") <= most).select("u", F.col("m").alias("lm"))
    told = edges.join(F.broadcast(heavy), "u", "left")
    few = told.filter("hm IS NULL").join(light, "u").select("u", "v", F.col("lm").alias("m"))
    return told.filter("hm IS NOT NULL").select("u", "v", F.col("hm").alias("m")).unionByName(few)


#: Edges up to which a graph is worked on by one task: a few MB at most, where rounds would take longer than the work.
SMALL = 50_000


def _settled(edges: DataFrame, kind: DataType) -> DataFrame:
    """(node, root) of few edges (u, v) in one task: trees are hooked under the smaller root of each edge, then flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        names, place = ends.dictionary.take(order), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        u, v = np.split(place[ends.indices.to_numpy()], 2)
        root, settled = np.arange(len(order)), False
        while not settled:
            before, least = root.copy(), np.minimum(root[u], root[v])
            for end in (u, v):
                np.minimum.at(root, before[end], least)
            while (root[root] != root).any():
                root = root[root]
            settled = np.array_equal(root, before)
        yield pa.RecordBatch.from_arrays([names, names.take(root)], ["node", "root"])

    schema = StructType([StructField("node", kind), StructField("root", kind)])
    return edges.select(F.col("u").cast(kind), F.col("v").cast(kind)).coalesce(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step takes a node's smallest neighbour by a
    map-side combined minimum and joins it back; minima of nodes with more than 20,000 edges
    and a ten-thousandth of all are broadcast (at most 20,000 rows), so that no node's neighbours are ever gathered in one
    place. Rounds needed grow with the logarithm of the edges. At most `small` edges of whole numbers or strings, counted
    first, settle in one task: rounds are jobs, whose plans stay with the driver. Edges with a null end are ignored; a loop names a node of its own.
    """
    kept = staged(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL"), "edges")
    size = kept.count()
    nodes = kept.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    kind = nodes.schema["node"].dataType
    if size <= small and (isinstance(kind, IntegralType) or kind == StringType()):
        return _settled(kept, kind)
    # Each edge points from the larger node u to the smaller v.
    state = kept.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    for _ in range(most_rounds):
        most = max(20_000, size // 10_000)
        split = size > max(most, small)
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = (_with_least(both, least, most) if split else both.join(least, "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        joined = _with_least(large, least, most) if split else large.join(least, "u")
        new = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        state = staged(new.distinct(), "edges")
        size, mixed = state.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if (size, mixed) == mark:
            roots = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        mark = size, mixed
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
