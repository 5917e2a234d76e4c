"""Tables that are worked out once: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, else the checkpoint folder that was set. Only a session that runs in
    one process (master local) gets a temporary folder where neither is given; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df written and read back: lineage ends there, and no executor's loss undoes it. Its path is added to `paths`, see delete."""
    path = new_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete what was staged at paths, once nothing reads it any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A name for the files under paths as they are now: their names, sizes and times of change, not what they hold. Spark
    lists and sums them up, however many they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    n, size, mixed = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))).first()
    return f"{n}-{size}-{mixed & (2**64 - 1):016x}"


def clear_staged(spark: SparkSession) -> bool:
    """Delete all that this application has staged; frames that read it can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
