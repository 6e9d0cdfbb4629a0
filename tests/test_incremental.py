"""The incremental star against a whole load, keys that clash, and which partitions a batch reads."""

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import keys, star
from listing_lake.sources import scratch
from listing_lake.streaming import incremental


@pytest.fixture(scope="module")
def features(spark):
    from listing_lake.plans.q_star import features_of

    return features_of(spark, "/root/testdata/sf0.001").where("year(scraping_date) = 1995 and month(scraping_date) < 3")


def loaded(spark, features, parts, space=None):
    base = scratch.folder(spark, "split")
    for i, some in enumerate(parts):
        features.where(some).write.parquet(f"{base}/source/part={i}")
        incremental.load_star(spark, f"{base}/source", features.schema, f"{base}/star", f"{base}/checkpoint", bucket=incremental.month, space=space)
    return base, incremental.read_star(spark, f"{base}/star")


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def by_names(tables):
    """Facts and bridges with the members' columns instead of keys."""
    out = {}
    for name in ("fact_listing", "listing_features_bridge", "surface_composition_bridge"):
        df = tables[name]
        for t, (key, columns) in star.DIMENSIONS.items():
            if key in df.columns:
                df = df.join(tables[t].select(key, F.to_json(F.struct(*(c for c in columns if c != "seller_type_id"))).alias(t)), key, "left").drop(key)
        out[name] = rows(df)
    return out


def test_any_split_gives_the_star_of_a_whole_load(spark, features):
    k = F.col("listing_id") % 3
    base, split = loaded(spark, features, [k < 2, k > 0])
    plain = star.normalised(features)
    assert {t: rows(df) for t, df in star.dimensions(plain).items()} == {t: rows(split[t]) for t in star.DIMENSIONS}
    assert rows(split["fact_listing"]) == rows(star.facts(plain))
    assert rows(split["listing_features_bridge"]) == rows(star.feature_bridge(plain)) and rows(split["surface_composition_bridge"]) == rows(star.surface_bridge(plain))
    # the same batch again, as after a failure at its end, and all files under a new checkpoint
    before = {t: rows(df) for t, df in split.items()}
    batch = spark.read.schema(features.schema).parquet(f"{base}/source/part=1")
    part = sorted(r[0] for r in spark.read.parquet(f"{base}/star/snapshots").select("batch").distinct().collect())[-1]
    incremental._add(batch, f"{base}/star", part, incremental.month, None)
    incremental.load_star(spark, f"{base}/source", features.schema, f"{base}/star", f"{base}/again", bucket=incremental.month)
    assert before == {t: rows(df) for t, df in incremental.read_star(spark, f"{base}/star").items()}


def test_star_with_clashing_keys(spark, features):
    few = features.where("listing_id % 40 < 3")
    k = F.col("listing_id") % 40
    tables = loaded(spark, few, [k < 2, k > 0], space=120)[1]
    want = star.normalised(few)
    assert any(tables[t].where(F.col(n) != keys.key(*c, space=120)).count() for t, (n, c) in star.DIMENSIONS.items())
    for t, (n, _) in star.DIMENSIONS.items():
        assert tables[t].select(n).distinct().count() == tables[t].count() == star.dimension(want, t).count(), t
    assert by_names(tables) == by_names(star.dimensions(want) | {"fact_listing": star.facts(want), "listing_features_bridge": star.feature_bridge(want), "surface_composition_bridge": star.surface_bridge(want)})


def test_members_with_one_hash_get_different_keys(spark):
    df = spark.createDataFrame([(f"m{i}" if i else None, i % 3) for i in range(30)], "x string, y int")
    made = keys.assigned(spark.createDataFrame([], "id long, x string, y int"), df.withColumn("id", F.lit(0)), ["x", "y"], "id", space=40)
    assert made.select("id").distinct().count() == 30 == made.select("x", "y").distinct().count()
    other = keys.exceptions(made, ["x", "y"], "id", space=40)
    assert other.count() > 0 and keys.exceptions(keys.members(df, ["x", "y"], "id"), ["x", "y"], "id").count() == 0
    old = made.where("y < 2")
    both = keys.merged(old.select("id", "x", "y"), df.select(F.lit(0).alias("id"), "x", "y"), "id", columns=["x", "y"], space=40)
    assert both.count() == 30 == both.select("id").distinct().count() and both.join(old, ["id", "x", "y"], "left_semi").count() == old.where("x is not null").count()


def test_a_batch_reads_its_own_buckets_only(spark):
    base = scratch.folder(spark, "buckets")
    history = spark.range(1000).select("id", F.expr("date_add(date'2020-01-01', cast(id as int))").alias("d"))
    incremental.append_new(history, f"{base}/t", ("id", "d"), "a", incremental.month(F.col("d")))
    batch = history.where("d >= '2022-08-20'").unionByName(spark.createDataFrame([(5000, "2022-09-25")], "id long, d string").withColumn("d", F.to_date("d")))
    new = incremental.append_new(batch, f"{base}/t", ("id", "d"), "b", incremental.month(F.col("d")))
    assert [r.id for r in new.collect()] == [5000]
    old = incremental.stored(spark, f"{base}/t", history.schema, ["2022-08", "2022-09"], without="b")
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert old.select(F.input_file_name()).distinct().count() == 2 < spark.read.parquet(f"{base}/t").select(F.input_file_name()).distinct().count()


def test_states_of_rates_add_up(spark):
    df = spark.range(500).select(F.lit("sale").alias("listing_type"), (F.col("id") % 7).cast("string").alias("scraping_date"), (F.col("id") / 997.0).alias("mortgage_rate"))
    parts = star.rate_state(df.where("mortgage_rate < 0.2")).unionByName(star.rate_state(df.where("mortgage_rate >= 0.2")))
    assert rows(star.mean_rates(parts)) == rows(star.adjusted_rates(df))


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64KB")
    rows = spark.range(0, 200_000, 1, 8).select("id", F.xxhash64("id").alias("x"), F.when(F.col("id") < 199_990, "1996").otherwise("1997").alias("bucket"))
    incremental.replace_partitions(rows, f"{tmp_path}/table", "bucket")
    spark.conf.unset(size)
    assert len(list((tmp_path / "table" / "bucket=1996").glob("*.parquet"))) > 4
    assert spark.read.parquet(f"{tmp_path}/table").select("id", "bucket").exceptAll(rows.select("id", F.col("bucket").cast("int"))).count() == 0
    assert spark.read.parquet(f"{tmp_path}/table").count() == 200_000
