"""Listing-shaped views over the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables

ENERGY = ("a", "a4", "b", "c", "d", "e", "f", "g")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind(status: Column) -> Column:
    return F.when(status == "O", "sale").when(status == "F", "rent").otherwise("auction")


def null_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each listing and scraping date; of a day's lines the dearest.

    Lines move once by their order, for the window and the join with orders, and once by their part (in a fixed number of
    partitions, as pages are large and rows aren't); names of nations come last.
    """
    t = lambda n: table(spark, sf_dir, n)
    order = Window.partitionBy("l_orderkey", "scraping_date").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    lines = t("lineitem").repartition("l_orderkey").withColumn("scraping_date", F.col("l_shipdate").cast("date")).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_partkey")
    rows = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    size, c = F.col("p_size"), F.col
    energy = F.lit(None).cast("string")
    for i, e in enumerate(ENERGY, 1):
        energy = F.when(size % 9 == i, e).otherwise(energy)
    return rows.select(
        c("l_orderkey").alias("listing_id"), "scraping_date", kind(c("o_orderstatus")).alias("listing_type"), null_if(c("l_linenumber") == 7, c("l_extendedprice")).alias("price"), null_if(c("l_quantity") >= 49, c("l_quantity")).alias("surface"),
        null_if(c("c_mktsegment") == "MACHINERY", c("c_mktsegment")).alias("seller_type"), null_if(c("o_orderpriority") == "4-NOT SPECIFIED", c("o_orderpriority")).alias("condition"), c("p_type").alias("type_of_property"), c("p_brand").alias("category_name"), c("p_name").alias("feature_text"),
        F.when(size % 5 == 0, None).when(size % 7 == 0, -size).otherwise(1950 + size).alias("building_year"), energy.alias("energy_class"), c("r_name").alias("region"), c("n_name").alias("province"),
        null_if(c("n_nationkey") == 24, 34.0 + c("n_nationkey") * 0.6).alias("latitude"), (6.0 + c("n_nationkey") * 0.5).alias("longitude"), null_if(c("l_tax") == 0, c("l_tax") / 2).alias("mortgage_rate"), size.alias("size"), c("l_discount").alias("discount"), c("l_tax").alias("tax"),
    )


LISTING_SQL = """listing AS (
  SELECT l_orderkey AS listing_id, scraping_date,
    CASE o_orderstatus WHEN 'O' THEN 'sale' WHEN 'F' THEN 'rent' ELSE 'auction' END AS listing_type,
    CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS price, CASE WHEN l_quantity < 49 THEN l_quantity END AS surface,
    nullif(c_mktsegment, 'MACHINERY') AS seller_type, nullif(o_orderpriority, '4-NOT SPECIFIED') AS condition,
    p_type AS type_of_property, p_brand AS category_name, p_name AS feature_text,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN -p_size ELSE 1950 + p_size END AS building_year,
    CASE p_size % 9 WHEN 1 THEN 'a' WHEN 2 THEN 'a4' WHEN 3 THEN 'b' WHEN 4 THEN 'c' WHEN 5 THEN 'd' WHEN 6 THEN 'e' WHEN 7 THEN 'f' WHEN 8 THEN 'g' END AS energy_class,
    r_name AS region, n_name AS province, CASE WHEN n_nationkey <> 24 THEN CAST(34.0 AS DOUBLE) + n_nationkey * CAST(0.6 AS DOUBLE) END AS latitude,
    CAST(6.0 AS DOUBLE) + n_nationkey * CAST(0.5 AS DOUBLE) AS longitude, CASE WHEN l_tax <> 0 THEN l_tax / 2 END AS mortgage_rate, p_size AS size, l_discount AS discount, l_tax AS tax
  FROM (SELECT *, CAST(l_shipdate AS DATE) AS scraping_date, row_number() OVER (PARTITION BY l_orderkey, CAST(l_shipdate AS DATE) ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  WHERE rn = 1
), first_listing AS (
  SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraping_date) = 1
), last_listing AS (
  SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraping_date DESC) = 1
)"""


def sql(body: str) -> str:
    """SQL over the listing view."""
    return f"WITH {LISTING_SQL}\n{body}" if not body.lstrip().startswith(",") else f"WITH {LISTING_SQL}{body}"


def half_even(x: str, digits: int = 2) -> str:
    """SQL: a number rounded half to even on its decimal text, as a double."""
    v = f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 16)) * {10**digits}"
    return f"(CASE WHEN ({x}) IS NOT NULL THEN (CASE WHEN {v} - floor({v}) > 0.5 THEN floor({v}) + 1 WHEN {v} - floor({v}) < 0.5 THEN floor({v}) ELSE floor({v}) + CAST(floor({v}) AS BIGINT) % 2 END) / CAST({float(10 ** digits)} AS DOUBLE) END)"


def half_up(x: str, precision: int, scale: int) -> str:
    """SQL: a number as a decimal, rounded half away from zero on its decimal text, as NUMERIC columns of databases do."""
    return f"CAST(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 16)) AS DECIMAL({precision}, {scale}))"


def pages(rows: DataFrame, real_estate: Column, title: Column, has_payload: Column, has_detail: Column) -> DataFrame:
    """Rows with an html column: a page with the JSON payload of a listing."""
    detail = F.struct(F.when(has_detail, F.struct(real_estate.alias("realEstate"))).alias("detailData"))
    payload = F.to_json(F.struct(F.struct(detail.alias("pageProps")).alias("props")))
    head = F.concat(F.lit("<html><head><title>  "), title, F.lit(" \n </title></head><body>"))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), payload, F.lit("</script>"))
    return rows.withColumn("html", F.concat(head, F.when(has_payload, script).otherwise(F.lit("<p>none</p>")), F.lit("</body></html>")))


def day_month_year(d: Column, year: str = "yyyy") -> Column:
    return F.date_format(d, f"dd/MM/{year}")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing view as raw snapshots: one page for each row, with everything that features are read from.

    Not written, as pages are many times as large as the tables: a page is made and parsed in one task. The observed count
    is a node that keeps Catalyst from merging what reads a page with what builds it.
    """
    tables.small_methods(spark)
    rows = listings(spark, sf_dir)
    c, id_, d, size = F.col, F.col("listing_id"), F.col("scraping_date"), F.col("size")
    text = lambda x: x.cast("string")
    whole = lambda x: text(x.cast("int"))
    element = lambda name, area, i: F.struct(F.lit(name).alias("constitution"), F.struct(whole(size % 4 + i).alias("value")).alias("floor"), F.concat(whole(area), F.lit(",5 m²")).alias("surface"), F.lit(100.0).alias("percentage"), F.lit("totale").alias("surfaceType"))
    property_ = F.struct(
        F.concat(F.lit("Aggiornato il "), F.when(F.year(F.date_sub(d, 30)) >= 2000, day_month_year(F.date_sub(d, (id_ % 30).cast("int")), "yy")).otherwise(day_month_year(F.date_sub(d, (id_ % 30).cast("int"))))).alias("lastUpdate"), F.struct(F.when(size % 3 > 0, F.array_repeat(F.lit("x"), size % 6)).alias("photos")).alias("multimedia"), F.struct(c("price").alias("value")).alias("price"),
        F.struct(F.concat(F.lit("€ "), whole(size + 1), F.lit("/mese")).alias("condominiumExpenses"), F.when(size % 2 == 0, F.concat(F.lit("€ "), whole(size * 10), F.lit("/anno"))).alias("heatingExpenses")).alias("costs"),
        F.concat(whole(c("surface")), F.lit(" m²")).alias("surface"),
        F.struct(F.array(element("Abitazione", size, 0), element("Box", size + 1, 1), element("Abitazione", size + 2, 2)).alias("surfaceConstitutionElements")).alias("surfaceConstitution"),
        F.lit("Libero").alias("availability"), F.struct(c("category_name").alias("name")).alias("category"), c("type_of_property").alias("typologyValue"), c("condition").alias("condition"),
        F.when(size % 4 == 0, "3+").otherwise(whole(size % 4)).alias("bathrooms"), F.when(size % 5 == 0, "2 - 5+").otherwise(whole(size % 5)).alias("bedRoomsNumber"), F.when(size % 6 == 0, "5+").otherwise(whole(size % 6)).alias("rooms"), F.lit("Kitchen Eat-in").alias("kitchenStatus"), F.when(size % 2 == 0, "1 in box").alias("garage"),
        F.struct(F.when(size % 10 == 0, "T").otherwise(whole(size % 10)).alias("abbreviation"), F.when(size % 10 == 0, "piano terra").otherwise(whole(size % 10)).alias("floorOnlyValue")).alias("floor"), F.split("feature_text", " ").alias("ga4features"),
        F.struct((size % 2 == 0).alias("zeroEnergyBuilding"), F.lit("Autonomo").alias("heatingType"), c("energy_class").alias("class"), F.concat(whole(size), F.lit(",25 kWh")).alias("epi"), F.lit("Assente").alias("airConditioning")).alias("energy"),
        F.struct(c("latitude").alias("latitude"), c("longitude").alias("longitude"), c("region").alias("region"), c("province").alias("province"), F.substring("province", 1, 2).alias("provinceId"), c("province").alias("city")).alias("location"),
        (size % 2 == 1).alias("elevator"), text(c("building_year")).alias("buildingYear"), F.concat(whole(size % 8 + 1), F.lit(" piani")).alias("floors"), whole(size).alias("residentialUnits"),
        F.concat(day_month_year(F.date_sub(d, 100)), F.lit(" - "), day_month_year(F.date_add(d, 300))).alias("workDates"),
        F.when(c("listing_type") == "auction", F.struct(day_month_year(F.date_add(d, 60)).alias("saleDateValue"), F.lit("Assegno").alias("modalityDeposit"), F.struct(F.lit(True).alias("isAvailable")).alias("saleState"), F.concat(F.lit("€ "), whole(c("price")), F.lit(",00")).alias("minimumOffer"), F.struct(size.alias("id"), F.lit("Residenziale").alias("name")).alias("lotCategory"))).alias("auction"),
        F.array(F.struct(whole(size).alias("cadastral"), F.lit("info").alias("cadastralInfo"))).alias("cadastrals"), F.concat(F.lit(" caption \n"), c("type_of_property")).alias("caption"), c("feature_text").alias("description"),
    )
    rate = F.struct(F.lit(80).alias("percent"), F.array(F.struct(F.lit(20).alias("year"), F.lit(0.9).alias("rate")), F.struct(F.lit(30).alias("year"), c("mortgage_rate").alias("rate"))).alias("rates"))
    estate = F.struct(
        F.unix_timestamp(F.date_sub(d, (id_ % 400).cast("int")).cast("timestamp")).alias("createdAt"), (size % 2 == 0).alias("isNew"), (size % 3 == 0).alias("luxury"), c("type_of_property").alias("title"),
        F.when(size % 4 > 0, F.struct(F.when(size % 4 > 1, F.struct(c("seller_type").alias("label"))).alias("agency"))).alias("advertiser"), F.struct(F.struct(F.array(F.struct(F.lit(70).alias("percent"), F.array(F.struct(F.lit(30).alias("year"), F.lit(0.8).alias("rate"))).alias("rates")), rate).alias("rates")).alias("mortgageWidget")).alias("mortgage"), F.array(property_).alias("properties"),
    )
    out = pages(rows, estate, c("type_of_property"), size != 13, F.lit(True)).withColumnRenamed("html", "html_source")
    return out.select("listing_id", "scraping_date", "listing_type", "html_source", null_if(id_ % 3 == 0, id_ + 1).alias("parent_listing"), F.when(id_ % 4 == 0, F.array(id_)).when(id_ % 4 == 1, F.array().cast("array<bigint>")).alias("child_listings"), "region", "province").observe(f"pages-{uuid.uuid4().hex}", F.count(F.lit(1)))
