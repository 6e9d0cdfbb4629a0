"""Stored predictions against SQL over their files; random samples."""

import duckdb
import pytest
from pyspark.sql import functions as F

from listing_lake.operators import explore, model
from listing_lake.plans import q_model
from listing_lake.plans.bindings import half_even
from listing_lake.sources import scratch

SF = "/root/testdata/sf0.001"


def test_predictions_dashboard_and_metrics_equal_sql(spark):
    fitted, rows, _ = q_model._fitted(spark, SF, "train", trees=6, depth=30)
    path = scratch.folder(spark, "predictions")
    stored = model.stored_predictions(fitted, rows, ["key", "listing_type", "price"], path)
    files = f"read_parquet('{path.removeprefix('file://')}/*.parquet')"
    ask = lambda text: duckdb.sql(text).fetchall()
    assert stored.count() == rows.count() > 0
    assert ask(f"SELECT count(*) FROM {files} WHERE abs(predicted_rent - {half_even('(exp(log_prediction) - 1) / 10', 0)} * 10) > 1e-6 OR predicted_rent IS NULL") == [(0,)]
    want = ask(f"SELECT listing_type, sqrt(avg((price - predicted_rent) ** 2)), avg(abs(price - predicted_rent)), 1 - sum((price - predicted_rent) ** 2) / (count(*) * var_pop(price)) FROM {files} GROUP BY 1 ORDER BY 1")
    got = model.metrics(stored, "price", "predicted_rent", ["listing_type"]).orderBy("listing_type").select("listing_type", "rmse", "mae", "r2").collect()
    assert [r[0] for r in got] == [r[0] for r in want] and all(tuple(g[1:]) == pytest.approx(w[1:], rel=1e-9) for g, w in zip(got, want, strict=True))
    shown = sorted(map(tuple, model.dashboard(fitted, rows).select("key", "predicted_rent").collect()))
    assert shown == sorted(ask(f"SELECT key, predicted_rent FROM {files} WHERE listing_type <> 'rent'"))


def test_forest_defaults_are_full_size():
    forest = model.pipeline(["x"], []).getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getCacheNodeIds()) == (100, 30, 1, True)


def test_random_sample(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    ids = lambda n, seed: [r.id for r in explore.sample(df, n, seed=seed).collect()]
    one = ids(20, 1)
    assert len(one) == len(set(one)) == 20 and set(one) <= set(range(500))
    assert one == ids(20, 1) and set(one) != set(ids(20, 2)) and max(one) > 100
    assert sorted(ids(900, 3)) == list(range(500)) and explore.sample(df.limit(0), 5, seed=1).count() == 0
