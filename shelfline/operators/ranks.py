"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.staging import staged


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's place, from 1, in an order.

    Rows are dealt to partitions by ranges of the order and sorted within; a row's place is its place there after the rows of the
    ranges before. Only the number of rows of each range goes through the driver. Rows that the order doesn't tell apart have places next to
    each other in any order; if they are many, name more columns, as equal rows share a range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition's number above 33 bits of the row's place in it. Written, so that both stay with the row.
    placed = staged(dealt.withColumn("_placed", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("_placed", 33), F.col("_placed").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range long, _before long"))
    return placed.join(known, part == F.col("_range")).withColumn(name, F.col("_before") + within + 1).drop("_placed", "_range", "_before")
