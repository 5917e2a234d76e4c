"""Tables of snapshots and the stream that lands in one: stops at every step, replays, files out of order."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from shelfline.sources.snapshots import Snapshots, VersionTaken
from shelfline.streaming import incremental as J

SCHEMA = "k long, v string, at timestamp"


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "k long, v string, at string").withColumn("at", F.col("at").cast("timestamp"))


def rows_of(df):
    return sorted(((r.k, r.v, str(r["at"])[:10]) for r in df.collect()), key=str)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


FIRST = [(1, "a", "2024-01-03"), (2, "b", "2024-01-09"), (3, "c", "2024-02-01"), (4, "d", "2024-03-05")]
NEXT = [(2, "B", "2024-03-06"), (5, "e", "2024-03-07"), (6, "f", "2024-04-01"), (7, "late", "2024-03-01")]
AFTER = [(1, "a", "2024-01-03"), (2, "B", "2024-03-06"), (3, "c", "2024-02-01"), (4, "d", "2024-03-05"), (5, "e", "2024-03-07"), (6, "f", "2024-04-01")]


def test_upsert_rewrites_only_what_it_touches(spark, make, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], "at")
    assert table.manifest() is None and table.upsert(make(*FIRST))["version"] == 1
    assert rows_of(table.read()) == sorted(FIRST, key=str)
    before = files(table.path)
    told = table.upsert(make(*NEXT))
    assert rows_of(table.read()) == sorted(AFTER, key=str) and rows_of(table.read(1)) == sorted(FIRST, key=str)
    assert told["written"] == ["2024-01", "2024-03", "2024-04"]  # January loses the row that moves to March
    assert all(files(table.path)[f] == t for f, t in before.items())  # what is written stays as it is
    first, second = table.manifest(1), table.manifest(2)
    assert first["parts"]["2024-02"] == second["parts"]["2024-02"] and "late" not in {r[1] for r in rows_of(table.read())}
    assert table.upsert(make(*NEXT)) is None and table.versions() == [1, 2]  # again: nothing is new
    assert rows_of(table.read_last()) == [(6, "f", "2024-04-01")]
    assert len(table.read_last().inputFiles()) == 1


def test_written_bytes_follow_the_batch(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], "at", "day")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + F.col("id") % n * 86400)
    table.upsert(spark.range(60_000).select(F.col("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("v"), day(60).alias("at")))
    whole = sum(map(os.path.getsize, files(table.path)))
    told = table.upsert(spark.range(60_000, 61_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit("2024-06-01").cast("timestamp").alias("at")))
    assert told["written"] == ["2024-06-01"] and sum(map(os.path.getsize, files(table.path))) < 1.05 * whole
    assert table.read().count() == 61_000


STEPS = ["_replaced", "_names", "commit", "_write", "_rename", "written"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("first_run", [True, False])
def test_a_stop_at_any_step_leaves_the_old_rows(spark, make, tmp_path, monkeypatch, step, first_run):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], "at")
    if not first_run:
        table.upsert(make(*FIRST))
    elif step == "_replaced":
        return

    class Stop(Exception):
        pass

    def stop(*args, **kwargs):
        raise Stop

    def stop_after(self, manifest, names=table._names):
        (tmp_path / "t" / "data" / "run=half" / "_part=2024-03").mkdir(parents=True)
        raise Stop

    with monkeypatch.context() as m:
        real = Snapshots._names
        if step == "_names":  # the stop comes after the data is written, before its parts are known
            m.setattr(Snapshots, "_names", lambda self, *names: stop() if names[0] == "data" else real(self, *names))
        elif step == "written":
            m.setattr(Snapshots, "commit", stop_after)
        else:
            m.setattr(Snapshots, step, stop)
        with pytest.raises(Stop):
            table.upsert(make(*(FIRST if first_run else NEXT)))
    assert table.versions() == ([] if first_run else [1])
    if not first_run:
        assert rows_of(table.read()) == sorted(FIRST, key=str)
        table.upsert(make(*NEXT))
        assert rows_of(table.read()) == sorted(AFTER, key=str)
        gone = table.clear_old(1)
        assert rows_of(table.read()) == sorted(AFTER, key=str) and table.versions() == [2] and (gone or step == "_replaced")
    else:
        table.upsert(make(*FIRST))
        assert rows_of(table.read()) == sorted(FIRST, key=str)


def test_a_version_taken_meanwhile(spark, make, tmp_path, monkeypatch):
    table, other = (Snapshots(spark, str(tmp_path / "t"), ["k"], "at") for _ in range(2))
    table.upsert(make(*FIRST))
    real = Snapshots.commit

    def slow(self, manifest):
        monkeypatch.setattr(Snapshots, "commit", real)
        other.upsert(make((9, "first", "2024-05-05")))
        return real(self, manifest)

    monkeypatch.setattr(Snapshots, "commit", slow)
    with pytest.raises(VersionTaken):
        table.upsert(make(*NEXT))
    assert (9, "first", "2024-05-05") in rows_of(table.read()) and table.versions() == [1, 2]


def test_duplicates_nulls_and_empty_sources(spark, make, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], "at")
    with pytest.raises(ValueError):
        table.upsert(make((1, "x", "2024-01-01"), (1, "y", "2024-01-02")))
    assert table.versions() == []
    table.upsert(make((1, "x", "2024-01-01"), (1, "y", "2024-01-02"), (None, "n", "2024-01-01"), (None, "n", "2024-01-01"), (5, "timeless", None)), on_duplicate="last")
    assert rows_of(table.read()) == sorted([(1, "y", "2024-01-02"), (None, "n", "2024-01-01"), (None, "n", "2024-01-01"), (5, "timeless", "None")], key=str)
    empty = Snapshots(spark, str(tmp_path / "e"), ["k"], "at")
    assert empty.upsert(make(*FIRST).limit(0))["parts"] == {} and empty.read().count() == empty.read_last().count() == 0
    assert empty.upsert(make(*FIRST)) is None  # no largest time to be past
    with pytest.raises(ValueError):
        Snapshots(spark, str(tmp_path / "x"), ["k"], "at").read()
    with pytest.raises(ValueError):
        Snapshots(spark, str(tmp_path / "x"), ["k"], "at", "year")


def test_newer_rows_replace_older_ones_whatever_their_order(spark, make, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(12), f"v{i}", f"2024-0{rng.randrange(1, 6)}-{rng.randrange(1, 28):02d}") for i in range(60)]
    want = sorted(({k: max((at, v, k) for k2, v, at in rows if k2 == k) for k, _, _ in rows}).values())
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        table = Snapshots(spark, str(tmp_path / f"t{seed}"), ["k"], "at")
        for i in range(0, 60, 20):
            table.upsert(make(*rows[i : i + 20]), on_duplicate="last", late="newer", batch=("s", i))
            table.upsert(make((99, "again", "2024-01-01")), late="newer", batch=("s", i))  # a batch that was brought
        assert sorted((at, v, k) for k, v, at in rows_of(table.read())) == want


def listing_files(folder, rng, n=3):
    rows = [(rng.randrange(12), f"v{i}", f"2024-01-{rng.randrange(1, 29):02d}") for i in range(45)]
    os.makedirs(folder)
    order = list(range(n))
    rng.shuffle(order)
    for age, i in enumerate(order):
        with open(f"{folder}/{i}.csv", "w") as f:
            f.write("k,v,at\n" + "".join(f"{k},{v},{at}\n" for k, v, at in rows[i * 15 : i * 15 + 15]))
        os.utime(f"{folder}/{i}.csv", (1_700_000_000 + age, 1_700_000_000 + age))
    return rows


def test_stream_gives_the_batch_rows(spark, make, tmp_path):
    rows = listing_files(f"{tmp_path}/in", random.Random(1))
    want = sorted({k: max((at, v, k) for k2, v, at in rows if k2 == k) for k, _, _ in rows}.values())
    table = Snapshots(spark, f"{tmp_path}/t", ["k"], "at")
    go = lambda: J.stream_listings(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/cp", table, delay="30 days", maxFilesPerTrigger=1)
    go()
    got = lambda: sorted((at, v, k) for k, v, at in rows_of(table.read()))
    assert got() == want and len(table.versions()) >= 3
    # The stream's last commit is lost: the batch is sent again, and the table stays as it is.
    commits = sorted(int(f) for f in os.listdir(f"{tmp_path}/cp/commits") if f.isdigit())
    for f in (f"{commits[-1]}", f".{commits[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/cp/commits/{f}"):
            os.remove(f"{tmp_path}/cp/commits/{f}")
    versions = table.versions()
    go()
    assert got() == want and table.versions() == versions
    # New files of another run.
    with open(f"{tmp_path}/in/more.csv", "w") as f:
        f.write("k,v,at\n0,newest,2024-02-01\n1,too old,2023-06-01\n")
    go()
    assert (0, "newest", "2024-02-01") in rows_of(table.read()) and "too old" not in {r[1] for r in rows_of(table.read())}
    assert json.dumps(table.manifest()["streams"])


def test_batches_are_written_once(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), ["k"], "at")
    batch = lambda n: spark.range(n * 3000, n * 3000 + 3000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 6 * 2_700_000).alias("at"))
    sizes = []
    for n in range(6):
        told = table.upsert(batch(n), on_duplicate="last", late="newer", batch=("s", n))
        sizes.append(sum(map(os.path.getsize, files(table.path))))
        assert len(told["written"]) == 6 and table.read().count() == 3000 * n + 3000
    assert sizes[-1] < 1.2 * 6 * sizes[0]
    # One key of an old batch comes again: its part is written anew, the others stay.
    kept = table.manifest()["parts"]
    table.upsert(spark.range(7, 8).select(F.col("id").alias("k"), F.lit("new").alias("v"), F.lit("2024-09-09").cast("timestamp").alias("at")), late="newer", batch=("s", 6))
    now = table.manifest()["parts"]
    assert [p for p in kept if now[p] != kept[p]] == ["2024-02"] and "2024-09" in now
    assert table.read().count() == 18_000 and table.read().filter("k = 7").first()["v"] == "new"


@pytest.mark.parametrize("runs, keys", [(1, 1_000_000), (2, 20), (64, 1)])
def test_runs_of_a_part_are_merged(spark, make, tmp_path, monkeypatch, runs, keys):
    from shelfline.sources import snapshots

    monkeypatch.setattr(snapshots, "MOST_RUNS", runs)
    monkeypatch.setattr(snapshots, "MOST_KEYS", keys)
    rng = random.Random(9)
    table, want = Snapshots(spark, str(tmp_path / "t"), ["k"], "at"), {}
    for n in range(6):
        rows = [(k, f"v{n}", f"2024-0{rng.randrange(1, 4)}-{rng.randrange(1, 28):02d}") for k in rng.sample(range(80), 30)]
        table.upsert(make(*rows), late="newer", batch=("s", n))
        for k, v, at in rows:
            want[k] = max(want.get(k, ("", "")), (at, v))
        table.clear_old(1)
        assert rows_of(table.read()) == sorted(((k, v, at) for k, (at, v) in want.items()), key=str)
        assert all(len(r) <= runs for r in table.manifest()["parts"].values()) and table.versions() == [n + 1]


def test_a_stream_leaves_nothing_staged(spark, tmp_path):
    from shelfline.staging import shared_dir

    left = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith(("batch-", "arrivals-"))} if os.path.isdir(shared_dir(spark)) else set()
    before = left()
    rows = listing_files(f"{tmp_path}/in", random.Random(2))
    table = Snapshots(spark, f"{tmp_path}/t", ["k"], "at")
    J.stream_listings(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/cp", table, delay="30 days", keep=1, maxFilesPerTrigger=1)
    assert sorted((at, v, k) for k, v, at in rows_of(table.read())) == sorted({k: max((at, v, k) for k2, v, at in rows if k2 == k) for k, _, _ in rows}.values())
    assert left() <= before and len(table.versions()) == 1
    named = {(r, p) for p, runs in table.manifest()["parts"].items() for r in runs}
    assert {(f.split("run=")[1].split("/")[0], f.split("_part=")[1].split("/")[0]) for f in files(table.path)} == named
