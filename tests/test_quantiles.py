"""Exact quantiles against the built-in percentile, whose state they avoid."""

import math

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import prep, report
from listing_lake.operators.quantiles import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    """Ties of a third of all rows, long tails, infinities, NULLs and NaNs; a group without values and one of one row."""
    x = F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.pow(F.rand(3) - 0.5, 7) * 1e9)
    x = F.when(F.col("id") % 97 == 1, F.lit(None)).when(F.col("id") % 1001 == 0, math.inf).when(F.col("id") % 1003 == 0, -math.inf).otherwise(x)
    g = F.when(F.col("id") == 5, "one").when(F.col("id") % 97 == 1, F.lit("none")).when(F.col("id") % 2 == 0, "even")
    return spark.range(6000).select(g.alias("g"), x.alias("x"), F.floor(F.rand(5) * 20).alias("y"))


@pytest.mark.parametrize(("bins", "most"), [(2048, 65_536), (8, 5), (2, 1)])
def test_equals_percentile(spark, values, bins, most):
    rows = values.persist()
    got = {r.g: (r.q_x, r.q_y) for r in quantiles(rows, ["x", "y"], SHARES, ["g"], bins, most).collect()}
    shares = F.array(*map(F.lit, SHARES))
    want = {r.g: (r.x, r.y) for r in rows.groupBy("g").agg(F.percentile("x", shares).alias("x"), F.percentile("y", shares).alias("y")).collect()}
    assert got.keys() == want.keys()
    for g, both in want.items():
        for mine, theirs in zip(got[g], both, strict=True):
            assert (theirs is None and mine == [None] * len(SHARES)) or all(a == b or math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b)) for a, b in zip(mine, theirs, strict=True)), g


def test_without_groups_and_without_values(spark):
    empty = spark.createDataFrame([], "x double, y int")
    assert [tuple(r) for r in quantiles(empty, ["x", "y"], [0.5]).collect()] == [([None], [None])]
    assert quantiles(empty, ["x"], [0.5], ["y"]).count() == 0
    some = spark.createDataFrame([(1.0, None), (math.nan, 3), (4.0, 4)], "x double, y int")
    assert [tuple(r) for r in quantiles(some, ["x", "y"], [0.5, 1.0]).collect()] == [([2.5, 4.0], [3.5, 4.0])]


def test_no_task_has_all_values(spark, values):
    """No aggregate keeps values, and windows order what a rank's range has left."""
    plan = quantiles(values, ["x"], [0.5], ["g"], 64, 50)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert all("_rank" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_users_of_medians(spark, values):
    df = values.where("abs(x) < 1e300").withColumn("building_year", F.when(F.col("y") > 15, -1).otherwise(F.col("y")))
    m = df.agg(F.percentile("x", 0.5)).first()[0]
    assert prep.medians(df, ["x", "y"]).first()[0] == pytest.approx(m)
    rows = report.by_region(df, "x", "g").collect()
    want = {r.g: r for r in df.where("g is not null").groupBy("g").agg(F.bround(F.percentile("x", 0.5), 2).alias("m"), F.count("x").alias("n")).collect()}
    assert {r.g: (r["median"], r["count"]) for r in rows} == {g: (r.m, r.n) for g, r in want.items()}
