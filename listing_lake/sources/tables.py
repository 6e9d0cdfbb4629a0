"""Sources and sinks: raw snapshots, provinces, Parquet, CSV and the star schema's tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .. import schemas
from ..functions.strings import place_name


def small_methods(spark: SparkSession) -> None:
    """Stages whose generated method is above 8,000 bytes, which Java leaves to its interpreter, run as projections in
    small methods. Spark's default allows 65,535 bytes; a session that has set another limit keeps it."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def raw_snapshots(spark: SparkSession, path: str, listing_type: str, format: str = "parquet") -> DataFrame:
    """A1: one listing type's raw documents, one row each; an unknown type or format is an error."""
    if listing_type not in schemas.LISTING_TYPES:
        raise ValueError(f"unknown listing type {listing_type!r}; known: {', '.join(schemas.LISTING_TYPES)}")
    if format not in ("parquet", "json"):
        raise ValueError(f"unknown format {format!r}")
    return spark.read.schema(schemas.RAW_SNAPSHOTS).format(format).load(path).where(F.col("listing_type") == listing_type)


def provinces(spark: SparkSession, path: str) -> DataFrame:
    """A2: the province table of a CSV file with Province, Code, Region, Macroregion; the code NA is a text."""
    return spark.read.csv(path, header=True, schema=schemas.PROVINCES, nullValue="\u0000", emptyValue="")


def with_province(df: DataFrame, table: DataFrame, name: str = "province", key: str = "Province", **columns: str) -> DataFrame:
    """A2: columns of the province table by name; an unknown name has empty texts. columns: new name = table's column."""
    right = table.select(place_name(key).alias("_p"), *(F.col(c).alias(n) for n, c in columns.items())).dropDuplicates(["_p"])
    return df.join(right, place_name(name) == F.col("_p"), "left").drop("_p").fillna("", list(columns))


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), limit: int | None = None) -> None:
    """A3"""
    (df if limit is None else df.limit(limit)).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A4"""
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def save_star(tables: dict[str, DataFrame], database: str) -> None:
    """A5: the tables of a database; facts and bridges are clustered by listing within their files."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in tables.items():
        df = df.sortWithinPartitions("listing_id") if "listing_id" in df.columns else df
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")


def load_star(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database)}


def from_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """A5: from a relational database; by ranges of a whole-number key, in as many connections as parts, if one is given.

    The key's bounds are asked of the database; rows outside of them, or with a NULL key, are in the outer ranges.
    """
    if key is None:
        return spark.read.jdbc(url, table, properties=properties)
    k = _quoted(spark, url, properties, key)[0]
    low, high = spark.read.jdbc(url, f"(SELECT MIN({k}) AS a, MAX({k}) AS b FROM {table}) bounds", properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=properties)


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    """A5: to a relational database, where a driver is on the class path."""
    df.write.jdbc(url, table, mode=mode, properties=properties)


def append_jdbc(df: DataFrame, url: str, table: str, keys: Sequence[str], stage: str | None = None, **properties: str) -> None:
    """A5: rows whose keys the table hasn't, safe to run again after any failure.

    Tasks write to a stage table, which a new attempt overwrites; then one statement of the database moves the
    rows that are missing, so the table has all of them or none. Rows with one key within df count once (any of them); NULL keys
    equal NULL keys.
    """
    spark, stage = df.sparkSession, stage or f"{table}_stage"
    df.dropDuplicates(list(keys)).write.jdbc(url, stage, mode="overwrite", properties=properties)
    names = ", ".join(_quoted(spark, url, properties, *df.columns))  # as Spark writes them
    named = _quoted(spark, url, properties, *keys)
    nulls = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    equal = "(t.{0} = s.{0} OR (t.{0} IS NULL AND s.{0} IS NULL))" if df.where(nulls).limit(1).count() else "t.{0} = s.{0}"  # the plain form finds rows by an index
    same = " AND ".join(equal.format(k) for k in named)
    statements = [f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})", f"DROP TABLE {stage}"]
    if not _has_table(spark, url, table, properties):
        df.limit(0).write.jdbc(url, table, mode="append", properties=properties)
        if not any(isinstance(df.schema[k].dataType, (StringType, BinaryType)) for k in keys):  # these are large objects for most databases
            _run(spark, url, [f"CREATE INDEX {table}_keys ON {table} ({', '.join(named)})"], properties)
    _run(spark, url, statements, properties)


def _connected(spark: SparkSession, url: str, properties: dict[str, str]):
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    return spark._jvm.java.sql.DriverManager.getConnection(url, given)


def _quoted(spark: SparkSession, url: str, properties: dict[str, str], *names: str) -> list[str]:
    connection = _connected(spark, url, properties)
    try:
        mark = connection.getMetaData().getIdentifierQuoteString()
        return [f"{mark}{n}{mark}" for n in names]
    finally:
        connection.close()


def _has_table(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> bool:
    connection = _connected(spark, url, properties)
    try:
        found = connection.getMetaData().getTables(None, None, None, None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == table.lower():
                return True
        return False
    finally:
        connection.close()


def _run(spark: SparkSession, url: str, statements: Sequence[str], properties: dict[str, str]) -> None:
    """Statements as one transaction."""
    connection = _connected(spark, url, properties)
    try:
        connection.setAutoCommit(False)
        work = connection.createStatement()
        for statement in statements:
            work.executeUpdate(statement)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def unload_star(tables: dict[str, DataFrame], url: str, keys: dict[str, Sequence[str]], **properties: str) -> None:
    """A5: a star's tables to a database, each by its keys: members and facts that are there already stay as they are."""
    for name, df in tables.items():
        append_jdbc(df, url, name, keys[name], **properties)
