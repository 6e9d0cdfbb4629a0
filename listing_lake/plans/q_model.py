"""Queries of KNN synthesis (I), features and model (J) and exploration (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import explore, features, model, report, synth
from ..sources import scratch, tables
from . import bindings as b
from .bindings import half_even, sql, table

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z, round(c_acctbal, 4) AS back FROM customer")
def i1_standardised(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    z = synth.standardised(c, ["c_acctbal"])
    back = synth.restored(z.drop("c_acctbal"), synth.scales(c, ["c_acctbal"]), ["c_acctbal"])
    return back.select("c_custkey", F.round("z_c_acctbal", 6).alias("z"), F.round("c_acctbal", 4).alias("back"))


@query("SELECT 'c_mktsegment' AS column_name, v AS value, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS place FROM (SELECT DISTINCT c_mktsegment AS v FROM customer) UNION ALL SELECT 'c_nationkey', v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS v FROM customer)")
def i2_domains(spark, sf_dir):
    return synth.domains(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT count(*) AS drawn, true AS all_known FROM customer")
def i3_seeds(spark, sf_dir):
    """As many rows drawn with replacement as there are; which ones depends on the seed."""
    c = table(spark, sf_dir, "customer")
    drawn = synth.seeds(c, c.count(), "c_custkey")
    return drawn.join(c.select("c_custkey", F.lit(True).alias("known")), "c_custkey", "left").agg(F.count("*").alias("drawn"), F.min(F.coalesce("known", F.lit(False))).alias("all_known"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label"))
    return e, e.where("row_id % 100 = 0").select(F.col("row_id").alias("seed_id"), "v")


_NEAR = """near AS (SELECT *, 1 / (d2 + 1e-6::DOUBLE) AS raw FROM (SELECT q.vec_id AS seed_id, r.vec_id AS row_id, r.label, list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
 FROM e q JOIN e r ON q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY d2, row_id) <= 5), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
_NEAR = "WITH e" + _NEAR.split(", e", 1)[1] + ", " + _NEAR.split(", e AS", 1)[0]


@query(_NEAR + " SELECT seed_id, row_id, round(d2, 6) AS d2, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY d2, row_id) AS INTEGER) AS rank FROM near")
def i4_neighbours(spark, sf_dir):
    data, queries = _vectors(spark, sf_dir)
    return synth.neighbours(queries, data, "v").withColumn("d2", F.round("d2", 6))


@query(_NEAR + " SELECT seed_id, round(sum(raw * label) / sum(raw), 5) AS label_mean, 1.0::DOUBLE AS weights FROM near GROUP BY 1")
def i5_weighted_means(spark, sf_dir):
    data, queries = _vectors(spark, sf_dir)
    near = synth.weighted(synth.neighbours(queries, data, "v"))
    total = near.groupBy("seed_id").agg(F.round(F.sum("w"), 6).alias("weights"))
    return synth.means(near, data.withColumn("label_mean", F.col("label").cast("double")), ["label_mean"]).join(total, "seed_id").withColumn("label_mean", F.round("label_mean", 5))


@query(_NEAR + " SELECT seed_id, label AS vote FROM (SELECT seed_id, CAST(label AS VARCHAR) AS label, round(sum(raw), 3) AS w FROM near GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY w DESC, label) = 1")
def i6_votes(spark, sf_dir):
    data, queries = _vectors(spark, sf_dir)
    near = synth.weighted(synth.neighbours(queries, data, "v"))
    return synth.votes(near, data.withColumn("vote", F.col("label").cast("string")), ["vote"])


@query()
def i7_synthesised(spark, sf_dir):
    """As many synthetic customers as there are: rows depend on the seed, so tests check their ranges."""
    columns = (F.col("c_custkey").alias("listing_id"), F.col("c_acctbal").alias("price"), F.col("c_nationkey").cast("double").alias("surface"))
    c = table(spark, sf_dir, "customer").select(*columns, F.col("c_mktsegment").alias("condition"))
    return synth.synthesised(c, c.count(), ["price", "surface"], ["condition"], ["price", "surface"])


@query(f"""SELECT p_partkey, {half_even('p_retailprice / 10', 0)} * 10 AS price, greatest(1, least(6, p_size)) AS total_room_number, greatest(1, least(4, p_size)) AS bathrooms_number, greatest(1, least(10, p_size)) AS energy_class, {half_even('p_retailprice / 7')} AS heating_yearly_expenses,
 CASE WHEN p_size % 2 = 0 THEN 'aquila' ELSE 'monza-brianza' END AS province FROM part""")
def i9_postprocessed(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("double")
    df = p.select("p_partkey", F.col("p_retailprice").alias("price"), (size + 0.25).alias("total_room_number"), size.alias("bathrooms_number"), (size - 0.25).alias("energy_class"), (F.col("p_retailprice") / 7).alias("heating_yearly_expenses"), F.when(F.col("p_size") % 2 == 0, "l'aquila").otherwise("monza-e-brianza").alias("province"))
    return synth.postprocessed(df)


@query("SELECT c_custkey AS listing_id, CASE WHEN c_nationkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS listing_type, c_acctbal AS price FROM customer")
def i10_combined(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("listing_id"), F.col("c_acctbal").alias("price"), "c_nationkey")
    return synth.combined({"rent": c.where("c_nationkey % 2 = 0").drop("c_nationkey"), "sale": c.where("c_nationkey % 2 = 1").drop("c_nationkey")}, shuffle_seed=2025)


_NAMES = ("attic", "cascina", "chalet", "shed", "two-family villa", "nowhere listed")


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'apartment' WHEN 1 THEN 'rural property' WHEN 2 THEN 'other' WHEN 3 THEN 'other' WHEN 4 THEN 'villa' END AS class, CASE p_size % 6 WHEN 0 THEN 'apartment' WHEN 1 THEN 'rural property' WHEN 4 THEN 'villa' ELSE 'other' END AS class_or_other FROM part")
def j1_property_class(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", features.property_class(name).alias("class"), features.property_class(name, other=True).alias("class_or_other"))


_HEATING = (
    ("independent, to radiators, methane powered", "independent", "radiator", "methane", "methane"), ("unknown", "unknown", "unknown", "unknown", "unknown"), ("centralized, floor-mounted, powered by heat pump", "centralized", "floor", "heat pump", "heat pump"),
    ("independent, air, fed to gpl", "independent", "air", "gpl", "gas"), ("stove, pellet", "unknown", "stove", "pellet", "other"), ("centralized, district heating", "centralized", "unknown", "district heating", "other"),
)
_pick = lambda i, rows: "CASE p_size % " + str(len(rows)) + " " + " ".join(f"WHEN {k} THEN '{r[i]}'" for k, r in enumerate(rows)) + " END"


@query(f"SELECT p_partkey, {_pick(1, _HEATING)} AS heating_type, {_pick(2, _HEATING)} AS heating_delivery, {_pick(3, _HEATING)} AS heating_power, {_pick(4, _HEATING)} AS power_class FROM part")
def j2_heating(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(r[0]) for r in _HEATING)), F.col("p_size") % len(_HEATING) + 1)
    out = table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in features.heating(text).items()))
    return out.withColumn("power_class", features.heating_power_class(F.col("heating_power")))


_AIR = (("independent, hot and cold", "independent", "1", "1"), ("absent", "absent", "0", "0"), ("Centralized, cold", "centralized", "0", "1"), ("plant predisposition, warm", "predisposition", "1", "0"), ("unknown", "unknown", "0", "0"))


@query(f"SELECT p_partkey, {_pick(1, _AIR)} AS ac_type, CAST({_pick(2, _AIR)} AS INTEGER) AS ac_hot, CAST({_pick(3, _AIR)} AS INTEGER) AS ac_cold FROM part")
def j3_air_conditioning(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(r[0]) for r in _AIR)), F.col("p_size") % len(_AIR) + 1)
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in features.air_conditioning(text).items()))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 2 THEN 'glass' ELSE 'double glass' END AS window_glass, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'metal' WHEN 2 THEN 'wood' ELSE 'metal, wood' END AS window_material FROM part")
def j4_windows(spark, sf_dir):
    size = F.col("p_size") % 4
    df = table(spark, sf_dir, "part").select("p_partkey", (size % 2).alias("window frames double glass / metal exterior"), (size >= 2).cast("int").alias("window frames exterior glass / wood"))
    return df.select("p_partkey", *(c.alias(n) for n, c in features.windows(df).items()))


@query(f"SELECT p_partkey, {_pick(1, _HEATING)} AS heating_type, {_pick(2, _HEATING)} AS heating_delivery, {_pick(4, _HEATING)} AS heating_power, {_pick(1, _AIR)} AS ac_type, CAST({_pick(2, _AIR)} AS INTEGER) AS ac_hot, CAST({_pick(3, _AIR)} AS INTEGER) AS ac_cold FROM part")
def j5_engineered(spark, sf_dir):
    pick = lambda rows: F.element_at(F.array(*(F.lit(r[0]) for r in rows)), F.col("p_size") % len(rows) + 1)
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("listing_id"), F.lit("x").alias("kitchen_status"), pick(_HEATING).alias("heating_type"), pick(_AIR).alias("air_conditioning"))
    return features.engineered(df)


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS seg_{s.lower()}" for s in _SEGMENTS) + ", CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_nan, c_nationkey FROM customer")
def j6_one_hot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", b.null_if(F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return features.one_hot(c, "c_mktsegment", _SEGMENTS, null_column=True, prefix="seg")


_TRIM = """, one AS (SELECT * FROM listing, (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM listing) WHERE price BETWEEN lo AND hi),
 two AS (SELECT listing_id, scraping_date, listing_type, price, surface FROM one, (SELECT quantile_cont(surface, 0.01) AS l2, quantile_cont(surface, 0.99) AS h2 FROM one) WHERE surface BETWEEN l2 AND h2)"""


@query(sql(_TRIM + " SELECT listing_id, scraping_date, round(ln(1 + price), 6) AS label, CAST(surface AS INTEGER) AS surface FROM two"))
def j7_j8_j9_trimmed(spark, sf_dir):
    rows = b.listings(spark, sf_dir).select("listing_id", "scraping_date", "price", "surface")
    out = features.log_target(features.trimmed(features.trimmed(rows, "price"), "surface"))
    out = features.cast_types(out, ["label"])
    return out.select(F.col("listing_id").cast("bigint").alias("listing_id"), "scraping_date", F.round("label", 6).alias("label"), "surface")


@query("SELECT 'quality' AS column_name, bool_and(quality IN (0, 1)) AS is_binary FROM labels UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM labels UNION ALL SELECT 'doc_id', bool_and(doc_id IN (0, 1)) FROM labels")
def j10_binary_columns(spark, sf_dir):
    return features.binary_columns(table(spark, sf_dir, "labels"))


@query(sql(_TRIM.replace("FROM listing", "FROM (SELECT * FROM listing WHERE listing_type = 'rent')").replace("SELECT * FROM (SELECT", "SELECT * FROM (SELECT") + " SELECT count(*) AS n, round(avg(ln(1 + price)), 6) AS label FROM two"))
def j11_training_frame(spark, sf_dir):
    rows = b.listings(spark, sf_dir).select("listing_id", "scraping_date", "listing_type", "price", "surface", "region")
    regions = [r.r_name for r in table(spark, sf_dir, "region").collect()]  # five names
    return features.training_frame(rows, {"region": regions}, []).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("label"))


NUMERIC, CATEGORICAL = ["surface", "size", "mortgage"], ["region", "condition"]


def _training(spark, sf_dir):
    rows = b.listings(spark, sf_dir).na.drop(subset=["price", "surface"]).fillna({"condition": "unknown", "mortgage_rate": 0.0})
    rows = rows.select(F.concat_ws("-", "listing_id", "scraping_date").alias("key"), "listing_id", "listing_type", "price", "surface", F.col("size").cast("double").alias("size"), F.col("mortgage_rate").alias("mortgage"), "region", "condition")
    return features.log_target(rows, "price", "label").withColumn("price", F.expm1("label"))


def _fitted(spark, sf_dir, fold, **options):
    """A forest over the rents of the training fold ("train") or all of them ("all"), saved once for an application."""
    rows = _training(spark, sf_dir)
    rent = rows.where("listing_type = 'rent'")
    train, test = model.split(rent, "key")
    known = train if fold == "train" else rent
    name = "-".join(map(str, ["model", fold, *options.values()]))
    return model.load(scratch.once_at(spark, name, sf_dir, lambda path: model.save(model.train(known, NUMERIC, CATEGORICAL, **options), path))), rows, test


@query()
def a6_j13_j14_j16_importances(spark, sf_dir):
    """100 trees of depth 30, on the training fold."""
    fitted, rows, _ = _fitted(spark, sf_dir, "train")
    return model.importances(fitted, rows)


@query()
def j13_j15_test_metrics(spark, sf_dir):
    """The same forest on the test fold, by condition."""
    fitted, _, test = _fitted(spark, sf_dir, "train")
    scored = model.stored_predictions(fitted, test, ["key", "price", "condition"], scratch.folder(spark, "predictions"))
    return model.metrics(scored, "price", "predicted_rent", ["condition"])


@query(sql("SELECT CAST(1 AS BIGINT) AS parts, count(*) AS n FROM listing WHERE price IS NOT NULL AND surface IS NOT NULL"))
def j12_split(spark, sf_dir):
    rows = _training(spark, sf_dir)
    train, test = (df.select("key") for df in model.split(rows, "key"))
    both = train.union(test).groupBy("key").agg(F.count("*").alias("parts"))
    return both.groupBy("parts").agg(F.count("*").alias("n"))


_LINEAR = ", scored AS (SELECT region, listing_type, price AS actual, price, surface * 1500 + CASE WHEN size % 2 = 0 THEN 500 ELSE 0 END AS predicted FROM listing WHERE price IS NOT NULL AND surface IS NOT NULL)"


def _linear(spark, sf_dir):
    rows = b.listings(spark, sf_dir).na.drop(subset=["price", "surface"])
    return rows.withColumns({"actual": F.col("price"), "predicted": F.col("surface") * 1500 + F.when(F.col("size") % 2 == 0, 500).otherwise(0)})


@query(sql(_LINEAR + " SELECT round(sqrt(avg((actual - predicted) ** 2)), 4) AS rmse, round(avg(abs(actual - predicted)), 4) AS mae, round(avg(abs(actual - predicted) / abs(nullif(actual, 0))) * 100, 4) AS mape, round(1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)), 6) AS r2 FROM scored"))
def j15_metrics(spark, sf_dir):
    return model.metrics(_linear(spark, sf_dir)).select(*(F.round(c, 6 if c == "r2" else 4).alias(c) for c in ("rmse", "mae", "mape", "r2")))


@query()
def j17_permutation_importance(spark, sf_dir):
    """All features, 100 repeats; a reduced forest, as each repeat scores the whole test fold."""
    fitted, _, test = _fitted(spark, sf_dir, "train", trees=10, depth=8)
    return model.permutation_importance(fitted, test, [*NUMERIC, *CATEGORICAL], "key")


@query(sql(_LINEAR + " SELECT CAST(CASE WHEN actual - predicted < -20000 THEN 0 WHEN actual - predicted >= 20000 THEN 9 ELSE floor((actual - predicted + 20000) / 5000) + 1 END AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1"))
def j18_residual_bins(spark, sf_dir):
    return model.residual_bins(_linear(spark, sf_dir), -20_000, 20_000, 8)


@query(sql("""SELECT concat_ws('-', listing_id, scraping_date) AS key, listing_type, region, true AS is_decade
FROM listing WHERE listing_type <> 'rent' AND price IS NOT NULL AND surface IS NOT NULL"""))
def j19_dashboard(spark, sf_dir):
    """The listings that aren't for rent; a predicted rent depends on the forest, but is a whole decade. 100 trees of depth 30."""
    fitted, rows, _ = _fitted(spark, sf_dir, "train")
    out = model.dashboard(fitted, rows)
    assert out.columns[0] == "predicted_rent"
    return out.select("key", "listing_type", "region", F.coalesce(F.col("predicted_rent") % 10 == 0, F.lit(False)).alias("is_decade"))


def _summary(x: str) -> str:
    return f"round({half_even(f'avg({x})')}, 1) AS mean, round(quantile_cont({x}, 0.5), 1) AS median, round({half_even(f'stddev_samp({x})')}, 1) AS std, min({x}) AS min, max({x}) AS max, count({x}) AS count"


def _rounded(df, names=("mean", "median", "std")):
    return df.withColumns({c: F.round(c, 1) for c in names})


@query(sql(_LINEAR + f" SELECT region, {_summary('predicted')} FROM scored GROUP BY 1"))
def j20_rent_by_region(spark, sf_dir):
    return _rounded(report.by_region(_linear(spark, sf_dir), "predicted"))


@query(sql(_LINEAR + f" SELECT listing_type, {_summary('predicted')}, round(avg(price), 1) AS mean_price, round(quantile_cont(price, 0.5), 1) AS median_price FROM scored GROUP BY 1"))
def j21_rent_by_type(spark, sf_dir):
    return _rounded(report.by_listing_type(_linear(spark, sf_dir), "predicted"), ("mean", "median", "std", "mean_price", "median_price"))


@query(sql(f"SELECT listing_id, scraping_date, CASE WHEN p <> 0 THEN {half_even('surface * 12 / p * 100')} END AS yield FROM (SELECT *, CASE WHEN size % 5 = 0 THEN 0 ELSE price END AS p FROM listing)"))
def j22_yield(spark, sf_dir):
    price = F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("price"))
    return b.listings(spark, sf_dir).select("listing_id", "scraping_date", numbers.rent_yield("surface", price).alias("yield"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def k2_first_rows(spark, sf_dir):
    return explore.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 10, order="c_custkey")


@query()
def k2_random_rows(spark, sf_dir):
    """Ten rows at random (the feature is the sample)."""
    return explore.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 10, seed=2025)


@query("SELECT count(*) AS n FROM lineitem")
def k3_count(spark, sf_dir):
    return explore.count(table(spark, sf_dir, "lineitem"))


@query("SELECT 'n_nationkey' AS column_name, 'int' AS type, CAST(min(CAST(n_nationkey AS VARCHAR)) AS VARCHAR) AS example FROM nation UNION ALL SELECT 'c_name', 'string', min(c_name) FROM customer UNION ALL SELECT 'c_custkey', 'bigint', min(CAST(c_custkey AS VARCHAR)) FROM customer")
def k4_schema(spark, sf_dir):
    parts = [explore.schema(table(spark, sf_dir, t).select(*c)) for t, c in (("nation", ["n_nationkey"]), ("customer", ["c_name", "c_custkey"]))]
    return parts[0].union(parts[1]).drop("nullable")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7 ORDER BY c_custkey LIMIT 100")
def k5_find(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey")
    return explore.find(rows, {"c_mktsegment": "BUILDING", "c_nationkey": 7}).select("c_custkey")


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def k6_sql(spark, sf_dir):
    frames = {t: table(spark, sf_dir, t) for t in ("customer", "nation", "region")}
    return explore.query(spark, "SELECT r_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY 1", **frames)


@query(" UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS n, true AS has_files FROM {t}" for t in ("lineitem", "orders", "part")))
def k7_status(spark, sf_dir):
    found = explore.status({t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")})
    return found.select("layer", "n", ((F.col("bytes") > 0) & (F.col("files") > 0)).alias("has_files"))
