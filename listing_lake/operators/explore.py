"""Table exploration: names with counts, samples, schemas, equality search, ad-hoc SQL, pipeline status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FOUND = 100


def kind_of(name: str) -> str:
    return "fact" if name.startswith("fact_") else "dimension" if name.startswith("dim_") else "bridge" if name.endswith("_bridge") else "other"


def tables(frames: dict[str, DataFrame]) -> DataFrame:
    """K1: (table_name, kind, n) of named tables."""
    parts = (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), F.lit(kind_of(t)).alias("kind"), "n") for t, df in sorted(frames.items()))
    return reduce(lambda a, b: a.union(b), parts)


def database_tables(spark: SparkSession, database: str) -> DataFrame:
    """K1 of a database of the catalogue."""
    return tables({t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database)})


def sample(df: DataFrame, n: int, seed: int | None = None, order: str | None = None) -> DataFrame:
    """K2: n rows at random (with a seed), or the first n by a column (the feature is the sample)."""
    return df.orderBy(F.rand(seed) if order is None else F.col(order)).limit(n)


def count(df: DataFrame) -> DataFrame:
    """K3"""
    return df.agg(F.count("*").alias("n"))


def schema(df: DataFrame) -> DataFrame:
    """K4: (column_name, type, nullable, example): an example is the least value as text."""
    one = df.agg(*(F.min(F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")))
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), (F.col(f.name) if f.name in one.columns else F.lit(None).cast("string")).alias("example")) for f in df.schema.fields]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def find(df: DataFrame, equal: dict[str, object], most: int = MOST_FOUND) -> DataFrame:
    """K5: rows with these values, at most a hundred (the feature is the cap)."""
    for c, v in equal.items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return df.limit(most)


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """K6: SQL over the catalogue and named frames."""
    return spark.sql(sql, **frames)


def status(layers: dict[str, DataFrame]) -> DataFrame:
    """K7: rows of each layer and bytes of its files, where it has some."""
    spark = next(iter(layers.values())).sparkSession
    parts = []
    for name, df in layers.items():
        files = df.inputFiles()
        jvm, total = spark.sparkContext._jvm, 0
        for f in files:
            path = jvm.org.apache.hadoop.fs.Path(f)
            total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        parts.append(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n", F.lit(len(files)).alias("files"), F.lit(total).cast("long").alias("bytes")))
    return reduce(lambda a, b: a.union(b), parts)
