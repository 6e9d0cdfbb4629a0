"""Every query with SQL against DuckDB on the smallest tables, properties of those without, and plan checks."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from listing_lake.operators import export, keys, prep, quality, synth
from listing_lake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{norm(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    want = sorted(tuple(norm(dict(zip(theirs, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in df.collect()) == want


def test_rows_of_the_others(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    assert registry.flagship(spark, SF).columns == ["region", "n", "median_price_per_sq_mt"]


def test_second_load_adds_nothing(spark):
    rows = spark.range(50).select(F.col("id").alias("listing_id"), F.lit("2024-01-01").alias("scraping_date"))
    once = quality.new_rows(rows, rows.limit(0))
    assert once.count() == 50 and quality.new_rows(rows, once).count() == 0


def test_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), (None, None)], "x string, y string")
    assert keys.members(df, ["x", "y"], "id").select("id").distinct().count() == 3


def test_weights_sum_to_one(spark):
    data = spark.range(40).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    near = synth.weighted(synth.neighbours(data.where("row_id < 5").select(F.col("row_id").alias("seed_id"), "v"), data, "v"))
    assert all(abs(r.s - 1) < 1e-9 and r.n == 5 for r in near.groupBy("seed_id").agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect())


def test_synthetic_rows_stay_in_range(spark):
    rows = QUERIES["i7_synthesised"](spark, SF).collect()
    bounds = spark.read.parquet(f"{SF}/customer.parquet").agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    assert len(rows) >= 10 and all(bounds[0] - 1e-6 <= r.price <= bounds[1] + 1e-6 and r.condition for r in rows)


def test_without_features_the_base_stays(spark):
    base = spark.range(3).withColumnRenamed("id", "listing_id")
    assert export.with_features(base, None) is base


def test_coordinates_are_required(spark):
    df = spark.createDataFrame([(40.0, 10.0), (None, 10.0), (60.0, 10.0)], "latitude double, longitude double")
    assert prep.in_country(df).count() == 1


@pytest.mark.parametrize("name", ["c25_to_c30_money", "d1_d6_latest", "h3_to_h7_categories", "j2_heating", "b1_b2_payload"])
def test_plans_have_no_python_and_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus = 'O'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan
