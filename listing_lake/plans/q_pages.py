"""Queries of the sources (A), page extraction (B) and features (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, pages
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


@query("SELECT o_orderkey AS listing_id, 'sale' AS listing_type, CAST(1 AS BIGINT) AS snapshots, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_date FROM orders WHERE o_orderstatus = 'O'")
def a1_raw_snapshots(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), scratch.folder(spark, "raw")
    raw = o.select(
        F.col("o_orderkey").alias("listing_id"), b.kind(F.col("o_orderstatus")).alias("listing_type"), F.lit("x").alias("province_name"), F.lit("X").alias("province_code"), F.lit(None).cast("bigint").alias("parent_listing"), F.lit(None).cast("array<bigint>").alias("child_listings"),
        F.array(F.struct(F.col("o_orderpriority").alias("html_source"), F.col("o_orderdate").cast("date").cast("string").alias("scraping_date"))).alias("data"),
    )
    tables.write_parquet(raw, path, ("listing_type",))
    found = tables.raw_snapshots(spark, path, "sale")
    return found.select("listing_id", "listing_type", F.size("data").cast("long").alias("snapshots"), F.element_at("data", 1)["scraping_date"].alias("first_date"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '' ELSE substr(n_name, 1, 2) END AS code, CASE WHEN c_nationkey = 3 THEN '' ELSE r_name END AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def a2_provinces(spark, sf_dir):
    path = scratch.folder(spark, "provinces")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tables.write_csv(nations.where("n_nationkey <> 3").select(F.col("n_name").alias("Province"), F.substring("n_name", 1, 2).alias("Code"), F.col("r_name").alias("Region"), F.col("r_name").alias("Macroregion")), path)
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.upper("n_name").alias("province"))
    return tables.with_province(customers, tables.provinces(spark, path), code="Code", region="Region").select("c_custkey", "code", "region")


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_custkey) AS customers FROM orders GROUP BY 1")
def a3_parquet_round_trip(spark, sf_dir):
    path = scratch.folder(spark, "parquet")
    tables.write_parquet(table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus")), path, ("status",))
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"), F.sum("o_custkey").cast("decimal(38,0)").alias("customers"))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer")
def a4_csv_round_trip(spark, sf_dir):
    path = scratch.folder(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", b.null_if(F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment")).alias("segment")), path)
    return tables.read_csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double, segment string")


_PART_FLAGS = "p_size % 7 <> 0 AS payload, p_size % 7 <> 0 AND p_size % 11 <> 0 AS detail"


def part_pages(spark, sf_dir):
    """A page for each part: some without payload, without detail data, without auction, with two properties."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    one = F.struct(F.struct(F.col("p_retailprice").alias("value")).alias("price"), F.when(size % 5 != 0, F.struct(F.lit("x").alias("saleType"))).alias("auction"))
    estate = F.struct(F.col("p_name").alias("title"), F.when(size % 3 == 0, F.array(one, one)).otherwise(F.array(one)).alias("properties"))
    return b.pages(p, estate, F.col("p_name"), size % 7 != 0, size % 11 != 0)


@query(f"""SELECT p_partkey, payload AS has_payload, CASE WHEN detail THEN p_retailprice END AS price, CASE WHEN detail THEN p_name END AS title FROM (SELECT *, {_PART_FLAGS} FROM part)""")
def b1_b2_payload(spark, sf_dir):
    json = pages.payload("html")
    price = F.get_json_object(json, f"{pages.DETAIL}.realEstate.properties[0].price.value").cast("double")
    return part_pages(spark, sf_dir).select("p_partkey", pages.has_payload("html").alias("has_payload"), price.alias("price"), F.get_json_object(json, f"{pages.DETAIL}.realEstate.title").alias("title"))


@query(f"""SELECT p_partkey, detail AS has_detail, detail AND p_size % 3 = 0 AS has_sublistings, CASE WHEN p_size = 14 THEN false WHEN NOT detail THEN true ELSE p_size % 5 <> 0 END AS is_auction FROM (SELECT *, {_PART_FLAGS} FROM part)""")
def b3_b4_b5_page_kind(spark, sf_dir):
    df = part_pages(spark, sf_dir).withColumn("html", b.null_if(F.col("p_size") == 14, F.col("html")))
    return df.select("p_partkey", pages.has_detail("html").alias("has_detail"), pages.has_sublistings("html").alias("has_sublistings"), pages.is_auction("html").alias("is_auction"))


@query("SELECT page_id, list_filter(['track(', 'VIDEO', '</article>'], lambda m: contains(lower(html), lower(m))) AS markers, contains(lower(html), 'track(') OR contains(lower(html), 'video') OR contains(lower(html), '</article>') AS is_blocked FROM pages")
def b6_block_markers(spark, sf_dir):
    markers = ("track(", "VIDEO", "</article>")
    return table(spark, sf_dir, "pages").select("page_id", pages.block_markers("html", markers).alias("markers"), pages.is_blocked("html", markers).alias("is_blocked"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')), '') AS title FROM pages")
def b7_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.title("html").alias("title"))


@query(r"""SELECT page_id, CAST(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/(\d+)(?:/[^/]*)?/?$', 1), '') AS BIGINT) AS url_id, page_id AS made_id FROM pages""")
def b8_listing_id(spark, sf_dir):
    made = F.concat(F.lit("https://www.listing.website/annunci/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/").otherwise("/foto?x=1"))
    return table(spark, sf_dir, "pages").select("page_id", pages.listing_id("url").alias("url_id"), pages.listing_id(made).alias("made_id"))


@query(r"""SELECT page_id, CAST(i AS INTEGER) AS place, links[i] AS link FROM (
  SELECT *, unnest(range(1, len(links) + 1)) AS i FROM (
    SELECT page_id, list_filter(hrefs, lambda h, k: list_position(hrefs, h) = k) AS links FROM (
      SELECT page_id, list_transform(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: contains(h, '/t')), lambda h: 'https://site.example' || h) AS hrefs FROM pages)))""")
def b9_search_links(spark, sf_dir):
    links = pages.listing_links("html", "/t", "https://site.example", need_id=False)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("place", "link")).withColumn("place", F.col("place") + 1)


@query("SELECT page_id, [page_id, page_id + 1] AS ids, CAST(2 AS INTEGER) AS n_links, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN CAST(page_id % 50 + 2 AS INTEGER) ELSE 7 END AS page_count FROM pages")
def b10_b11_sublistings_page_count(spark, sf_dir):
    i = F.col("page_id").cast("string")
    a = lambda href, name, text="": F.concat(F.lit('<a class="'), F.lit(name), F.lit('" href="'), href, F.lit(f'">{text}'))
    unit = lambda n: F.concat(a(F.concat(F.lit("https://x.example/annunci/"), (F.col("page_id") + n).cast("string"), F.lit("/")), pages.SUBLISTING_CLASS), F.lit("</a>"))
    link = lambda text: F.concat(a(F.lit("#"), pages.PAGE_LINK_CLASS), text, F.lit("</a>"))
    stop = lambda text: F.concat(F.lit(f'<div class="{pages.PAGE_STOP_CLASS}">'), text, F.lit("</div>"))
    bar = F.when(F.col("page_id") % 3 == 1, F.concat(link((F.col("page_id") % 50 + 2).cast("string")), link(F.lit("next")), stop(F.lit("...")))).when(F.col("page_id") % 3 == 2, F.concat(link(F.lit("2")), stop(F.lit("7")))).otherwise("")
    df = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", unit(0), F.lit('<a href="/other/">'), i, F.lit("</a>"), unit(1), bar))
    links = pages.sublisting_links("html")
    return df.select("page_id", pages.listing_ids(links).alias("ids"), F.size(links).alias("n_links"), pages.page_count("html").alias("page_count"))


def _features(spark, sf_dir, *groups):
    return extract.features(b.listing_pages(spark, sf_dir), only=groups).select("listing_id", "scraping_date", "listing_features.*")


_ON = "size <> 13"


def _if(x: str) -> str:
    return f"CASE WHEN {_ON} THEN {x} END"


@query(sql(f"""SELECT listing_id, scraping_date, {_if('CAST(listing_id % 400 AS INTEGER)')} AS listing_age, {_if('CAST(listing_id % 30 AS INTEGER)')} AS listing_last_update, {_if('listing_id % 3 <> 0')} AS has_parent, {_if('listing_id % 4 <= 1')} AS has_child,
 {_if("CASE size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'privato' ELSE seller_type END")} AS seller_type, {_if('CASE WHEN size % 3 > 0 THEN size % 6 END')} AS number_of_photos FROM listing"""))
def x2_to_x6_listing_info(spark, sf_dir):
    return _features(spark, sf_dir, "listing_info").select("listing_id", "scraping_date", *(f"listing_info.{c}" for c in ("listing_age", "listing_last_update", "has_parent", "has_child", "seller_type", "number_of_photos")))


@query(sql(f"""SELECT listing_id, scraping_date, {_if('mortgage_rate')} AS mortgage_rate, {_if('price')} AS price, {_if('surface')} AS total_surface, {_if(half_even('price / surface', 2))} AS price_per_sq_mt FROM listing"""))
def x1_x7_x8_price(spark, sf_dir):
    return _features(spark, sf_dir, "additional_costs", "price", "total_surface", "price_per_sq_mt").select("listing_id", "scraping_date", "additional_costs.mortgage_rate", "price", "total_surface", "price_per_sq_mt")


@query(sql(""" SELECT listing_id, scraping_date, element_name, CAST(size % 4 + k AS VARCHAR) AS floor, CAST(size + k AS DOUBLE) + 0.5 AS surface, CAST(100 AS DOUBLE) AS percentage
FROM listing, (VALUES ('Abitazione', 2), ('Box', 1)) e(element_name, k) WHERE size <> 13"""))
def x9_surface_composition(spark, sf_dir):
    return _features(spark, sf_dir, "surface_composition").select("listing_id", "scraping_date", F.explode_outer("surface_composition").alias("element_name", "e")).where("element_name IS NOT NULL").select("listing_id", "scraping_date", "element_name", "e.floor", "e.surface", "e.percentage")


@query(sql(f"""SELECT listing_id, scraping_date, {_if('lower(type_of_property)')} AS class, {_if('lower(category_name)')} AS category, {_if('size % 3 = 0')} AS is_luxury, {_if('lower(condition)')} AS condition,
 {_if('CASE WHEN size % 4 = 0 THEN 4 ELSE size % 4 END')} AS bathrooms_number, {_if('CASE WHEN size % 5 = 0 THEN 6 ELSE size % 5 END')} AS bedrooms_number, {_if('CASE WHEN size % 6 = 0 THEN 6 ELSE size % 6 END')} AS total_room_number,
 {_if("'kitchen eat-in'")} AS kitchen_status, {_if('size % 10')} AS property_floor FROM listing"""))
def x10_x11_x12_rooms(spark, sf_dir):
    return _features(spark, sf_dir, "type_of_property", "condition", "rooms_info").select("listing_id", "scraping_date", "type_of_property.*", "condition", *(f"rooms_info.{c}" for c in ("bathrooms_number", "bedrooms_number", "total_room_number", "kitchen_status", "property_floor")))


@query(sql(f"""SELECT listing_id, scraping_date, {_if('size % 2 = 0')} AS is_zero_energy_building, {_if('energy_class')} AS energy_class, {_if('size + 0.25')}::DOUBLE AS energy_consumption, {_if('latitude')} AS latitude, {_if('longitude')} AS longitude,
 {_if("replace(lower(region), ' ', '-')")} AS region, {_if("replace(lower(province), ' ', '-')")} AS province, {_if('substr(province, 1, 2)')} AS province_code FROM listing"""))
def x13_x14_energy_location(spark, sf_dir):
    return _features(spark, sf_dir, "energy_info", "location_info").select("listing_id", "scraping_date", *(f"energy_info.{c}" for c in ("is_zero_energy_building", "energy_class", "energy_consumption")), *(f"location_info.{c}" for c in ("latitude", "longitude", "region", "province", "province_code")))


@query(sql(f"""SELECT listing_id, scraping_date, {_if('size % 2 = 1')} AS has_elevator, {_if('building_year')} AS building_year, {_if('size % 8 + 1')} AS total_building_floors, {_if('size')} AS total_number_of_residential_units,
 {_if("CAST(CAST(scraping_date - INTERVAL 100 DAY AS DATE) AS VARCHAR)")} AS work_start_date, {_if("CAST(CAST(scraping_date + INTERVAL 300 DAY AS DATE) AS VARCHAR)")} AS work_end_date, {_if('CAST(0.25 AS DOUBLE)')} AS work_completion FROM listing"""))
def x15_building(spark, sf_dir):
    return _features(spark, sf_dir, "building_info").select("listing_id", "scraping_date", *(f"building_info.{c}" for c in ("has_elevator", "building_year", "total_building_floors", "total_number_of_residential_units", "work_start_date", "work_end_date", "work_completion")))


@query(sql("""SELECT listing_id, scraping_date, CASE WHEN a THEN strftime(scraping_date + INTERVAL 60 DAY, '%d/%m/%Y') END AS auction_end_date, CASE WHEN a THEN true END AS is_open, CASE WHEN a THEN CAST(trunc(price) AS DOUBLE) END AS minimum_offer,
 CASE WHEN a THEN size END AS lot_id, CASE WHEN size <> 13 THEN CAST(size AS VARCHAR) END AS cadastral FROM (SELECT *, listing_type = 'auction' AND size <> 13 AS a FROM listing)"""))
def x16_x17_auction_cadastral(spark, sf_dir):
    return _features(spark, sf_dir, "auction_info", "cadastral_info").select("listing_id", "scraping_date", "auction_info.auction_end_date", "auction_info.is_open", "auction_info.minimum_offer", F.col("auction_info.lot_category.id").alias("lot_id"), "cadastral_info.cadastral")


@query(sql("""SELECT listing_id, scraping_date, CASE WHEN size <> 13 THEN type_of_property END AS title, CASE WHEN size <> 13 THEN 'caption ' || type_of_property END AS caption, CASE WHEN size <> 13 THEN feature_text END AS description, size = 13 AS no_features FROM listing"""))
def x18_x19_d7_texts(spark, sf_dir):
    from ..operators.quality import clean_fields

    df = extract.features(b.listing_pages(spark, sf_dir), only=["text_info"])
    df = clean_fields(df.select("listing_id", "scraping_date", F.col("listing_features").isNull().alias("no_features"), "listing_features.text_info"))
    return df.select("listing_id", "scraping_date", "text_info.*", "no_features")


def flagship(spark, sf_dir):
    """Median price per square metre by region from raw pages, latest snapshot of each listing."""
    from ..operators.quality import latest
    from ..operators.quantiles import quantiles

    df = _features(spark, sf_dir, "price_per_sq_mt", "location_info").select("listing_id", "scraping_date", "location_info.region", "price_per_sq_mt")
    df = scratch.kept(latest(df).where("region is not null").select("region", "price_per_sq_mt"))
    medians = quantiles(df, ["price_per_sq_mt"], [0.5], ["region"]).select("region", F.round(F.col("q_price_per_sq_mt")[0], 4).alias("median_price_per_sq_mt"))
    return df.groupBy("region").agg(F.count("price_per_sq_mt").alias("n")).join(medians, "region", "left")


@query(sql(f"""SELECT replace(lower(region), ' ', '-') AS region, count({half_even('price / surface', 2)}) AS n, round(quantile_cont({half_even('price / surface', 2)}, 0.5), 4) AS median_price_per_sq_mt FROM last_listing WHERE size <> 13 GROUP BY 1"""))
def flagship_median_price(spark, sf_dir):
    return flagship(spark, sf_dir)
