"""Queries of analytical extracts (G) and cleaning (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export, prep, star
from . import bindings as b
from .bindings import half_even, sql, table
from .q_star import rows_of

QUERIES, SQL = {}, {}
#: The feature names of the tables, for the SQL; the query takes them from the table.
FEATURES = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = oracle
        return f

    return add


def _star(spark, sf_dir, *tables):
    """Facts, dimensions and normalised rows, of which the query reads the tables named."""
    rows = rows_of(spark, sf_dir, *tables)
    return star.facts(rows), star.dimensions(rows), rows


@query(sql("SELECT listing_id, scraping_date AS date_value FROM first_listing"))
def g1_earliest_dates(spark, sf_dir):
    facts, dims, _ = _star(spark, sf_dir, "dim_date")
    return export.earliest_dates(facts, dims["dim_date"])


@query(sql("""SELECT listing_id, listing_type, CASE WHEN s THEN CAST(price AS DECIMAL(15, 2)) END AS price, CASE WHEN s THEN CAST(surface AS DECIMAL(15, 2)) END AS surface, CASE WHEN s THEN CASE size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'privato' ELSE lower(seller_type) END END AS seller_type,
 CASE WHEN s THEN lower(type_of_property) END AS type_of_property, CASE WHEN s THEN building_year END AS building_year, CASE WHEN s THEN replace(lower(region), ' ', '-') END AS region, CASE WHEN s THEN replace(lower(province), ' ', '-') END AS province, CASE WHEN s THEN size % 10 END AS floor FROM (SELECT *, size <> 13 AS s FROM first_listing)"""))
def g2_wide(spark, sf_dir):
    read = ("dim_date", "dim_listing_type", "dim_listing_info", "dim_seller_type", "dim_type_of_property", "dim_building_info", "dim_location_info", "dim_rooms_info")
    facts, dims, _ = _star(spark, sf_dir, "fact_listing", *read)
    out = export.wide(facts, {t: dims[t] for t in read})
    return out.select("listing_id", "listing_type", "price", "surface", "seller_type", "type_of_property", "building_year", "region", "province", "floor")


@query(sql("SELECT DISTINCT listing_id, lower(w) AS feature_name FROM (SELECT listing_id, unnest(string_split(feature_text, ' ')) AS w FROM first_listing WHERE size <> 13) WHERE w <> ''"))
def g3_earliest_features(spark, sf_dir):
    facts, dims, rows = _star(spark, sf_dir, "dim_date", "dim_features")
    return export.earliest_features(facts, dims["dim_date"], star.feature_bridge(rows), dims["dim_features"])


@query(sql("SELECT listing_id, " + ", ".join(f"CAST(list_contains(string_split(lower(feature_text), ' '), '{c}') AS INTEGER) AS has_{c}" for c in FEATURES) + ", size FROM first_listing"))
def g4_g5_wide_features(spark, sf_dir):
    first = b.listings(spark, sf_dir).groupBy("listing_id").agg(F.min_by(F.struct("feature_text", "size"), "scraping_date").alias("f")).select("listing_id", "f.*")
    long = first.select("listing_id", F.explode(F.split(F.lower("feature_text"), " ")).alias("feature_name")).where("feature_name <> ''")
    return export.with_features(first.select("listing_id", "size"), export.one_column_each(long, export.names_of(long), prefix="has_"))


@query(sql("SELECT listing_type, count(*) AS n FROM first_listing GROUP BY 1"))
def g6_listing_counts(spark, sf_dir):
    facts, dims, _ = _star(spark, sf_dir, "dim_date", "dim_listing_type")
    return export.listing_counts(facts, dims["dim_date"], dims["dim_listing_type"])


@query(sql(f"SELECT listing_type, CAST({half_even('count(*) / 100', 0)} * 100 AS BIGINT) AS n FROM first_listing GROUP BY 1"))
def g7_i11_volume_plan(spark, sf_dir):
    facts, dims, _ = _star(spark, sf_dir, "dim_date", "dim_listing_type")
    return export.rounded_counts(export.listing_counts(facts, dims["dim_date"], dims["dim_listing_type"]), 100)


@query(sql("SELECT listing_id, scraping_date, price FROM listing WHERE listing_type = 'rent'"))
def g8_one_type(spark, sf_dir):
    return export.of_type(b.listings(spark, sf_dir).select("listing_id", "scraping_date", "price", "listing_type"), "rent")


def frame(spark, sf_dir):
    """The listing view as a wide frame for cleaning."""
    c, size = F.col, F.col("size")
    rows = b.listings(spark, sf_dir)
    names = F.when(size % 6 == 0, "mansarda").when(size % 6 == 1, "holiday home").when(size % 6 == 2, "♪").otherwise(c("type_of_property"))
    return rows.select(
        "listing_id", "scraping_date", "listing_type", "price", "surface", "seller_type", "condition", "building_year", "energy_class", "region", "province", "latitude", "longitude",
        F.concat(names, F.lit(" | "), "category_name").alias("type_of_property"), b.null_if(size % 4 == 0, size % 2 == 1).alias("has_elevator"), b.null_if(size % 3 == 0, F.lit("box")).alias("garage"),
    )


_FRAME = """, frame AS (SELECT listing_id, scraping_date, listing_type, price, surface, seller_type, condition, building_year, energy_class, region, province, latitude, longitude,
 CASE size % 6 WHEN 0 THEN 'attic' WHEN 1 THEN 'vacation house' WHEN 2 THEN 'unknown' ELSE type_of_property END AS type_of_property, CASE WHEN size % 4 <> 0 THEN size % 2 = 1 END AS has_elevator, CASE WHEN size % 3 <> 0 THEN 'box' END AS garage FROM listing),
 m AS (SELECT quantile_cont(price, 0.5) AS price, quantile_cont(surface, 0.5) AS surface, quantile_cont(CAST(building_year AS DOUBLE), 0.5) AS year, quantile_cont(latitude, 0.5) AS latitude, quantile_cont(longitude, 0.5) AS longitude,
  quantile_cont(CAST(CASE energy_class WHEN 'a4' THEN 1 WHEN 'b' THEN 5 WHEN 'c' THEN 6 WHEN 'd' THEN 7 WHEN 'e' THEN 8 WHEN 'f' THEN 9 WHEN 'g' THEN 10 END AS DOUBLE), 0.5) AS energy FROM frame)"""


@query(sql(_FRAME + " SELECT listing_id, scraping_date, round(coalesce(frame.price, m.price), 4) AS price, round(coalesce(frame.surface, m.surface), 4) AS surface, CASE WHEN coalesce(building_year, year) < 0 THEN y2 ELSE coalesce(building_year, year) END AS building_year FROM frame, m, (SELECT quantile_cont(coalesce(building_year, year), 0.5) AS y2 FROM frame, m)"))
def h1_h2_medians(spark, sf_dir):
    out = prep.fix_negative(prep.impute(frame(spark, sf_dir), ["price", "surface", "building_year"]))
    return out.select("listing_id", "scraping_date", F.round("price", 4).alias("price"), F.round("surface", 4).alias("surface"), "building_year")


@query(sql(_FRAME + """ SELECT listing_id, scraping_date, coalesce(seller_type, 'unknown') AS seller_type, coalesce(condition, 'unknown') AS condition, coalesce(CAST(has_elevator AS INTEGER), 0) AS has_elevator, CAST(garage IS NOT NULL AS INTEGER) AS garage, type_of_property,
 coalesce(CASE energy_class WHEN 'a4' THEN 1 WHEN 'b' THEN 5 WHEN 'c' THEN 6 WHEN 'd' THEN 7 WHEN 'e' THEN 8 WHEN 'f' THEN 9 WHEN 'g' THEN 10 END, energy) AS energy_class FROM frame, m"""))
def h3_to_h7_categories(spark, sf_dir):
    df = prep.fill_unknown(frame(spark, sf_dir), ["seller_type", "condition"])
    df = df.withColumns({"has_elevator": prep.as_flag(F.col("has_elevator")), "garage": prep.present(F.col("garage")), "energy_class": prep.energy_rank(F.col("energy_class")), "type_of_property": prep.property_type(F.col("type_of_property"))})
    return prep.impute(df, ["energy_class"]).select("listing_id", "scraping_date", "seller_type", "condition", "has_elevator", "garage", "type_of_property", "energy_class")


@query(sql("SELECT listing_id, scraping_date FROM listing WHERE price IS NOT NULL AND longitude BETWEEN 6 AND 19 AND latitude BETWEEN 35 AND 48"))
def h8_h9_h11_row_filters(spark, sf_dir):
    return prep.in_country(prep.complete(prep.drop_if_present(frame(spark, sf_dir), "garage", "not there"))).select("listing_id", "scraping_date")


@query("SELECT c AS column_name, r AS role, CASE WHEN n >= 0 THEN true END AS present FROM (VALUES ('listing_id', 'numeric'), ('price', 'numeric'), ('surface', 'numeric'), ('building_year', 'numeric'), ('latitude', 'numeric'), ('longitude', 'numeric'), ('seller_type', 'categorical'), ('condition', 'categorical'), ('region', 'categorical'), ('province', 'categorical')) v(c, r), (SELECT count(*) AS n FROM lineitem)")
def h10_roles(spark, sf_dir):
    df = frame(spark, sf_dir).drop("scraping_date", "listing_type", "energy_class", "type_of_property", "has_elevator", "garage")
    numeric, categorical = prep.roles(df)
    named = [F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("role")) for r, cs in (("numeric", numeric), ("categorical", categorical)) for c in cs]
    return df.agg((F.count("*") >= 0).alias("present")).select(F.explode(F.array(*named)).alias("r"), "present").select("r.*", "present")


@query(sql(_FRAME + """ SELECT listing_id, scraping_date, listing_type, price, surface, coalesce(seller_type, 'unknown') AS seller_type, type_of_property, round(latitude, 6) AS latitude FROM frame WHERE price IS NOT NULL AND longitude BETWEEN 6 AND 19 AND latitude BETWEEN 35 AND 48"""))
def g9_real_data_export(spark, sf_dir):
    """Cleaned without numeric imputation."""
    out = prep.prepared(frame(spark, sf_dir), fill_numeric=False)
    return out.select("listing_id", "scraping_date", "listing_type", "price", "surface", "seller_type", "type_of_property", F.round("latitude", 6).alias("latitude"))
