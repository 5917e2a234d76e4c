"""Incremental tables and streams: upserts past a watermark, tombstones, rescoring, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.sources.snapshots import Snapshots
from shelfline.staging import delete, staged


def new_rows(source: DataFrame, target: DataFrame | None, watermark: Column, target_mark: Column | None = None) -> DataFrame:
    """All rows at first; later those past the target's largest mark. Late rows are dropped; an empty target takes none."""
    if target is None:
        return source
    last = target.agg(F.max(watermark if target_mark is None else target_mark).alias("_last"))
    return source.join(F.broadcast(last), watermark > F.col("_last"), "left_semi")  # one row


def incremental_upsert(source: DataFrame, target: DataFrame | None, keys: list[str], watermark: Column, on_duplicate: str = "error", order: list[str] | None = None) -> DataFrame:
    """The target after one run: its rows whose keys don't come again, and the source's new rows.

    Keys that a batch has twice are an error, or the last in order counts.
    """
    fresh = new_rows(source, target, watermark)
    if on_duplicate == "last":
        rest = [c for c in source.columns if c not in keys]
        best = fresh.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("_r"))
        fresh = best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*source.columns)
    elif on_duplicate == "error":
        twice = fresh.groupBy(*keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"the batch has a key twice: {twice[0]}")
    else:
        raise ValueError("on_duplicate is error or last")
    if target is None:
        return fresh
    return target.join(fresh.select(*keys), keys, "left_anti").select(*source.columns).unionByName(fresh)


def upsert_table(source: DataFrame, path: str, keys: list[str], watermark: str, every: str = "month", **kwargs) -> Snapshots:
    """One run of an incremental table at a path: rows past its largest time come in, each in place of the one with its keys.
    Readers find the old rows or the new ones, wherever a run stops, and only the months (or days) concerned are written."""
    table = Snapshots(source.sparkSession, path, keys, watermark, every)
    table.upsert(source, **kwargs)
    return table


def tombstones(df: DataFrame, key: str, carried: list[str], at: Column, deleted: str = "deleted_at", created: str = "created_at") -> DataFrame:
    """A marker row for each row: key and carried columns stay, the times are set, all else is null."""
    keep = {key, *carried}
    times = {deleted: at, created: at}
    return df.select(*(times[f.name].cast(f.dataType).alias(f.name) if f.name in times else F.col(f.name) if f.name in keep else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))


def rescored(latest: DataFrame, scores: DataFrame, key: str, filled: list[str], replaced: list[str], at: Column, created: str = "created_at") -> DataFrame:
    """A new row for each scored one: filled columns prefer what is there, replaced ones are the score's."""
    s = scores.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in [*filled, *replaced]))
    joined = latest.join(s, F.col(key) == F.col("_key"))
    new = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in filled} | {c: F.col(f"_{c}") for c in replaced} | {created: at}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in latest.columns))


def resume(todo: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """What isn't in the table yet; all of it if there is no table."""
    spark = todo.sparkSession
    if not spark.catalog.tableExists(table):
        return todo
    return todo.join(spark.table(table).select(*keys).distinct(), keys, "left_anti")


def latest_in_state(rows: DataFrame, keys: list[str], time: str, order: list[str], delay: str, window: str = "1 day") -> DataFrame:
    """Of a stream, the last row in order of each key and window of time. The state store holds that row until the stream's
    watermark (the largest time less `delay`) has passed the window's end; later rows of the window are dropped, as are rows without a time."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    # Where the order has all columns the largest one is the row, and state holds it once.
    last = F.max_by(F.struct(*order, *rest), F.struct(*order)) if rest else F.max(F.struct(*order))
    best = rows.withWatermark(time, delay).groupBy(*keys, F.window(time, window)).agg(last.alias("_r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns))


_STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Versions of state that a run can go on from: the last one, and the one before in case that its batch is sent again.
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def stream_listings(spark: SparkSession, path: str, schema, checkpoint: str, table: Snapshots, transform=None, delay: str = "7 days", fmt: str = "csv", keep: int | None = None, **options):
    """A file source that lands in a table of snapshots: runs through the files that are there and stops.

    Keyed event-time state holds each key's latest row, and what changes in a batch goes to the table, where a row gives way to
    one that comes after it only. So the order of files and how they fall into batches don't change the result, as long as
    rows are no later than `delay`. The table's manifest keeps the last batch that this stream has brought: a batch that is sent
    again, because the run stopped between the table's commit and the stream's, changes nothing. State is kept in RocksDB, on disk.
    What a batch stages goes once the table has it. With `keep`, so do what the table's last `keep` versions don't name, and those before them.
    """
    source = spark.readStream.schema(schema).options(**({"header": "true"} | options if fmt == "csv" else options)).format(fmt).load(path)
    rows = transform(source) if transform else source
    order = [table.time, *(c for c in rows.columns if c not in (table.time, *table.keys))]

    def bring(df: DataFrame, number: int) -> None:
        # Written first, whatever comes of it, so that every batch's state is worked out once and kept.
        made: list[str] = []
        try:
            table.upsert(staged(df, "arrivals", made), on_duplicate="last", order=order, late="newer", batch=(checkpoint, number))
        finally:
            delete(spark, made)
        if keep:
            table.clear_old(keep)

    before = {name: spark.conf.get(name, None) for name in _STREAM}
    for name, value in _STREAM.items():
        spark.conf.set(name, value)
    try:
        query = latest_in_state(rows, table.keys, table.time, order, delay).writeStream.outputMode("update").foreachBatch(bring).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return query
