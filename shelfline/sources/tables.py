"""Writing and changing tables: audit columns, refreshes, schema growth, layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_audit(df: DataFrame, at: Column | None = None) -> DataFrame:
    """One load time for all rows of a run."""
    return df.withColumn("_loaded_at", F.current_timestamp() if at is None else at)


def append_with_audit(df: DataFrame, table: str, at: Column | None = None) -> None:
    """Append every row, none dropped, stamped with the run's load time."""
    with_audit(df, at).write.mode("append").saveAsTable(table)


def full_refresh(df: DataFrame, table: str, on_empty: str = "keep") -> bool:
    """Replace a table's rows. An empty input keeps what is there, or truncates; tells whether it wrote."""
    if on_empty not in ("keep", "truncate"):
        raise ValueError("on_empty is keep or truncate")
    if on_empty == "keep" and df.isEmpty():
        return False
    df.write.mode("overwrite").saveAsTable(table)
    return True


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """df with the target's missing columns as nulls; none is dropped."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields if f.name.lower() not in have))


#: Types that hold all values of those before them, by family: what Parquet's reader widens as it reads.
_WIDER = [[T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()], [T.FloatType(), T.DoubleType()], [T.ByteType(), T.ShortType(), T.IntegerType(), T.DoubleType()], [T.DateType(), T.TimestampNTZType()]]


def widened(schemas: list[T.StructType]) -> T.StructType:
    """One schema for files of several: all columns in the order they came in, each of the narrowest type that holds all its own."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            key = f.name.lower()
            if key not in fields:
                fields[key] = T.StructField(f.name, f.dataType, True)
            elif fields[key].dataType != f.dataType:
                both = next(([t for t in row if t in (f.dataType, fields[key].dataType)] for row in _WIDER if f.dataType in row and fields[key].dataType in row), None)
                if both is None:
                    raise ValueError(f"{f.name}: no type holds both {fields[key].dataType.simpleString()} and {f.dataType.simpleString()}")
                fields[key] = T.StructField(fields[key].name, both[-1], True)
    return T.StructType(list(fields.values()))


def append_generation(df: DataFrame, path: str, generation: str) -> None:
    """Add rows to a stored table of files, in whatever columns and types they have; nothing that is there is written anew. A
    generation that is there already is an error, so that a job that is run again doesn't add its rows twice."""
    df.write.parquet(f"{path}/generation={generation}")


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of all its generations: columns that a generation lacks are null, types are widened as files are read, no
    column is dropped. Schemas come from one footer of each generation."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(conf).listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("generation="))
    if not names:
        raise ValueError(f"{path} has no generation")
    schema = widened([spark.read.parquet(f"{path}/{n}").schema for n in names])
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("generation", T.StringType())])).option("basePath", path).parquet(*(f"{path}/{n}" for n in names))


def create_or_replace(name: str, df: DataFrame) -> None:
    """Create a table from a query, replacing one of that name."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Export with a fixed order of columns and a header; outer blanks stay."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: Each layer's materialization unless a model says otherwise.
MATERIALIZATION = {"raw": "view", "staging": "table", "dwh": "table", "datamart": "view"}


@dataclass
class Layers:
    """Names and materializations of models by layer."""

    default_schema: str = "default"
    schemas: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)

    def schema_of(self, layer: str) -> str:
        """A custom schema's name as it stands, else the default."""
        return (self.schemas.get(layer) or "").strip() or self.default_schema

    def kind_of(self, layer: str, model: str) -> str:
        return self.overrides.get(model, MATERIALIZATION[layer])

    def materialize(self, spark: SparkSession, layer: str, model: str, df: DataFrame) -> DataFrame:
        """A view stays a plan; a table is written; both can be read by the model's name."""
        if self.kind_of(layer, model) == "view":
            df.createOrReplaceTempView(model)
            return df
        schema = self.schema_of(layer)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
        create_or_replace(f"`{schema}`.`{model}`", df)
        return spark.table(f"`{schema}`.`{model}`")
