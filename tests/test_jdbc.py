"""Relational load and unload through Derby, the database that PySpark's jars hold."""

import uuid

import pytest
from pyspark.sql import functions as F

from listing_lake.sources import tables


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"


def test_append_is_repeatable(spark, url):
    rows = spark.range(100).select(F.when(F.col("id") != 3, F.col("id")).alias("k"), F.col("id").cast("string").alias("v"))
    for some in (rows.where("cast(v as int) < 60"), rows.where("cast(v as int) >= 40"), rows.where("cast(v as int) >= 40"), rows.unionByName(rows)):
        tables.append_jdbc(some, url, "t", ["k"])
    read = tables.from_jdbc(spark, url, "t", "k", parts=4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 100 and read.where("k is null").count() == 1
    assert {(r.k, r.v) for r in rows.collect()} == {tuple(r) for r in read.collect()}
    assert not tables._has_table(spark, url, "t_stage", {})


def test_a_failed_move_leaves_the_table_as_it_was(spark, url):
    rows = spark.range(10).select(F.col("id").alias("k"))
    tables.append_jdbc(rows, url, "t", ["k"])
    with pytest.raises(Exception, match="NOSUCH"):
        tables._run(spark, url, ["DELETE FROM t", "INSERT INTO nosuch VALUES (1)"], {})
    assert tables.from_jdbc(spark, url, "t").count() == 10


def test_empty_tables(spark, url):
    tables.append_jdbc(spark.range(0).withColumnRenamed("id", "k"), url, "t", ["k"])
    assert tables.from_jdbc(spark, url, "t", "k").count() == 0
