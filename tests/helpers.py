"""Rows of a Spark query and of its SQL, made comparable."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)


def duck_rows(sql, folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def one(spark, column, **values):
    """A column's value over one row of literals."""
    from pyspark.sql import functions as F

    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]
