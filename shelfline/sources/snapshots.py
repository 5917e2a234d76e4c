"""Tables kept as snapshots: immutable Parquet folders by day or month, a manifest for each version, and a commit by renaming.

    <path>/data/run=<id>/_part=2001-01/part-*.parquet     written once, never changed
    <path>/versions/000000000003.json                     which runs hold each part, the largest time, what streams have brought

A version is there from the moment its manifest has its name, which one rename gives it; the one before stays readable. A
run that stops anywhere before leaves folders that no manifest names, and the table as it was. A version that another writer has
taken meanwhile fails the commit, so that no rows are lost. An upsert writes its own rows, beside those of the parts they fall into,
and writes anew only the parts that it replaces rows of; the manifest carries the rest over. So a table that grows by many small
batches is written once, not once for each batch. What passes through the driver is the manifest: a line for each day or month and run in it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.staging import delete, staged

#: A part that lies in this many runs is written anew, as one, when more rows come to it.
MOST_RUNS = 64
#: Hashes of a batch's keys are broadcast in blocks of this many, up to so many blocks; beyond, the table's keys are shuffled.
MOST_KEYS, MOST_BLOCKS = 1_000_000, 8
PARTS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
_RUN, _PART = "run", "_part"


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this one was about to; run again."""


class Snapshots:
    """A table of rows with unique keys and a time, at a path in a file system that all tasks reach.

    Its first version comes with the first upsert. Rows with a null key column are kept and replace none; rows without a
    time share a part of their own. Parts are days or months of the session's time zone. Columns of a later source must be those of the table (see `widened` in sources.tables).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str, every: str = "month"):
        if every not in PARTS:
            raise ValueError("every is day or month")
        self.spark, self.path, self.keys, self.time, self.every = spark, path.rstrip("/"), keys, time, every

    # Files

    def _file(self, *names: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, *names: str) -> list[str]:
        fs, at = self._file(*names)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _write(self, text: str, *names: str) -> None:
        fs, at = self._file(*names)
        out = fs.create(at, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _rename(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        """A rename that fails if the target is there."""
        context = self.spark.sparkContext
        jvm, (_, a), (_, b) = context._jvm, self._file(*source), self._file(*target)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), context._jsc.hadoopConfiguration()).rename(a, b, how)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionTaken(f"{b} is there already") from e
            raise

    # Versions

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, by default the last one's; None before the first commit."""
        known = self.versions()
        if not known:
            return None
        at = known[-1] if version is None else version
        fs, path = self._file("versions", f"{at:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        name = f"{manifest['version']:012d}.json"
        aside = f".{uuid.uuid4().hex}"
        self._write(json.dumps(manifest, indent=1), "versions", aside)
        try:
            self._rename(("versions", aside), ("versions", name))
        except VersionTaken:
            fs, at = self._file("versions", aside)
            fs.delete(at, False)
            raise

    # Reading

    @staticmethod
    def _runs(manifest: dict, part: str) -> list[str]:
        """The runs that hold a part; older manifests name one."""
        runs = manifest["parts"].get(part, [])
        return [runs] if isinstance(runs, str) else runs

    def _rows(self, manifest: dict, parts: list[str]) -> DataFrame:
        """Rows of parts with the part's name; a filter on `_part` reads no others."""
        columns = T.StructType.fromJson(manifest["schema"])
        schema = T.StructType([*columns.fields, T.StructField(_RUN, T.StringType()), T.StructField(_PART, T.StringType())])
        paths = [f"{self.path}/data/{_RUN}={run}/{_PART}={p}" for p in parts for run in self._runs(manifest, p)]
        if not paths:
            return self.spark.createDataFrame([], schema).drop(_RUN)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop(_RUN)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(found, sorted(found["parts"])).drop(_PART)

    def read_last(self, version: int | None = None) -> DataFrame:
        """Rows of the last day or month that has rows, known from the manifest: one part is read."""
        found = self.manifest(version)
        timed = [p for p in (found or {"parts": {}})["parts"] if p != "none"]
        if found is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(found, [max(timed)] if timed else []).drop(_PART)

    # Writing

    def part_of(self, time: Column) -> Column:
        return F.coalesce(F.date_format(time, PARTS[self.every]), F.lit("none"))

    def _replaced(self, old: DataFrame, fresh: DataFrame) -> list[str]:
        """Parts that hold a key of the new rows: only key columns are read, and of the table only rows whose key's hash a batch has are shuffled."""
        stored, blocks, mix = old.select(*self.keys, _PART), -(-fresh.count() // MOST_KEYS), F.xxhash64(*self.keys)
        found = set()
        for k in range(blocks if blocks <= MOST_BLOCKS else 1):
            keys = fresh.select(*self.keys)
            if blocks <= MOST_BLOCKS:
                keys = keys.filter(F.pmod(mix, F.lit(blocks)) == k)
                stored = old.select(*self.keys, _PART, mix.alias("_mix")).join(F.broadcast(keys.select(mix.alias("_mix")).distinct()), "_mix", "left_semi")
            found |= {r[0] for r in stored.join(keys, self.keys, "left_semi").select(_PART).distinct().collect()}
        return sorted(found)

    def upsert(self, source: DataFrame, on_duplicate: str = "error", order: list[str] | None = None, late: str = "drop", batch: tuple[str, int] | None = None) -> dict | None:
        """Bring new rows in, each in place of the one with its keys, and give the new manifest (None if nothing is new).

        The first run takes all rows. Later ones take rows past the table's largest time and drop late ones; a table that
        has lost all its rows has no such time and takes none. late="newer" takes rows of any time instead, if in `order` they
        come after the stored row of their keys. Keys that a source has twice are an error, or with "last" the last in order counts, or with "unique" the caller knows of none.
        `batch` (stream, number): what a stream has brought once isn't brought again, however often it is sent.
        """
        if on_duplicate not in ("error", "last", "unique") or late not in ("drop", "newer"):
            raise ValueError("on_duplicate is error, last or unique, late is drop or newer")
        made: list[str] = []
        try:
            return self._upsert(source, on_duplicate, order, late, batch, made)
        finally:
            delete(self.spark, made)

    def _upsert(self, source: DataFrame, on_duplicate: str, order: list[str] | None, late: str, batch: tuple[str, int] | None, made: list[str]) -> dict | None:
        now = self.manifest()
        if now and batch and now["streams"].get(batch[0], -1) >= batch[1]:
            return None
        columns = source.columns if now is None else [f["name"] for f in now["schema"]["fields"]]
        fresh, time, kind = source.select(*columns), F.col(self.time), source.schema[self.time].dataType
        order = order or [self.time, *(c for c in columns if c not in (self.time, *self.keys))]
        if now and late == "drop":
            fresh = fresh.filter(time > F.lit(now["mark"]).cast(kind)) if now["mark"] is not None else fresh.filter("false")
        if on_duplicate == "last":
            # A maximum that tasks combine first, so that a key of many rows meets in none; rows with a null key pass.
            named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))
            rest = [c for c in columns if c not in self.keys]
            last = F.max(F.struct(*order)) if set(order) == set(rest) else F.max_by(F.struct(*rest), F.struct(*order))
            best = fresh.filter(named).groupBy(*self.keys).agg(last.alias("_r"))
            fresh = best.select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*columns).unionByName(fresh.filter(~named))
        fresh = staged(fresh.withColumn(_PART, self.part_of(time)), "batch", made)
        old = self._rows(now, sorted(now["parts"])) if now else None
        if on_duplicate == "error":
            twice = fresh.groupBy(*self.keys).count().filter("count > 1").dropna(subset=self.keys).limit(1).collect()
            if twice:
                raise ValueError(f"the batch has a key twice: {twice[0]}")
        told = lambda rows: rows.agg(F.sort_array(F.collect_set(_PART)), self._text(F.max(time), kind)).first()
        brought, last = told(fresh)  # a name for each part
        replaced = self._replaced(old, fresh) if now and brought else []
        if late == "newer" and replaced:
            # The table's rows of these keys first, from the parts that hold some: a batch that is small is broadcast, and the table isn't shuffled.
            held = self._rows(now, replaced)
            stored = held.join(fresh.select(*self.keys), self.keys, "left_semi").select(*self.keys, F.struct(*order).alias("_stored"))
            fresh = staged(fresh.join(stored, self.keys, "left").filter(F.col("_stored").isNull() | (F.struct(*order) > F.col("_stored"))).select(*columns, _PART), "batch", made)
            brought, last = told(fresh)
            replaced = self._replaced(held, fresh) if brought else []
        if not brought and now and not batch:
            return None
        kept = {p: self._runs(now, p) for p in now["parts"]} if now else {}
        touched = sorted({*brought, *replaced})
        anew = [p for p in touched if p in replaced or len(kept.get(p, [])) >= MOST_RUNS]
        rows = fresh.select(*columns, _PART)
        if anew:
            rows = self._rows(now, anew).join(fresh.select(*self.keys), self.keys, "left_anti").select(*columns, _PART).unionByName(rows)
        run = uuid.uuid4().hex
        mark = None if now is None else now["mark"]
        if touched:
            rows.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.path}/data/{_RUN}={run}")
            written = {n.partition("=")[2] for n in self._names("data", f"{_RUN}={run}") if n.startswith(f"{_PART}=")}
            kept = {p: r for p, r in kept.items() if p not in anew}
            kept |= {p: [*kept.get(p, []), run] for p in written}
            mark = last if mark is None or (last is not None and (late == "drop" or self._later(last, mark, kind))) else mark
        schema = T.StructType([f for f in fresh.schema.fields if f.name != _PART]).jsonValue() if now is None else now["schema"]
        streams = ({} if now is None else now["streams"]) | ({batch[0]: batch[1]} if batch else {})
        manifest = {"version": 1 if now is None else now["version"] + 1, "mark": mark, "parts": dict(sorted(kept.items())), "streams": streams, "written": touched, "schema": schema}
        self.commit(manifest)
        return manifest

    @staticmethod
    def _text(time: Column, kind: T.DataType) -> Column:
        """A time as text that means the same in every session."""
        return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if isinstance(kind, T.TimestampType) else time.cast("string")

    def _later(self, a: str, b: str, kind: T.DataType) -> bool:
        return self.spark.range(1).select(F.lit(a).cast(kind) > F.lit(b).cast(kind)).first()[0]

    def clear_old(self, keep: int = 2) -> list[str]:
        """Delete runs, and parts in runs, that none of the last `keep` versions names, and the manifests before; give their names. For
        times when no one writes, or reads an older version."""
        known = self.versions()
        named = {(r, p) for m in map(self.manifest, known[-keep:]) for p in m["parts"] for r in self._runs(m, p)}
        gone, runs = [], {r for r, _ in named}
        for name in self._names("data"):
            run = name.partition("=")[2]
            if run not in runs:
                gone.append(name)
            else:
                gone += [f"{name}/{n}" for n in self._names("data", name) if n.startswith(f"{_PART}=") and (run, n.partition("=")[2]) not in named]
        for names in [("versions", f"{v:012d}.json") for v in known[:-keep]] + [("data", n) for n in gone]:
            fs, at = self._file(*names)
            fs.delete(at, True)
        return gone
