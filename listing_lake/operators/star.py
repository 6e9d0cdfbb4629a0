"""The star schema from normalised snapshots: one normaliser, dimensions, fact and bridges.

Dimensions and facts use the same normalised columns, so a fact's foreign key is the member's key by construction.
A NULL feature group makes no member and a NULL foreign key; a group of NULL columns maps to the all-NULL member.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, numbers
from ..functions.numbers import col
from .keys import duplicates, key, members, natural, orphans

#: Natural keys of the dimensions by table: (key column, columns).
DIMENSIONS = {
    "dim_seller_type": ("seller_type_id", ["seller_type"]),
    "dim_listing_info": ("listing_info_id", ["listing_age", "listing_last_update", "number_of_pictures", "seller_type_id"]),
    "dim_date": ("date_id", ["date_value"]),
    "dim_availability": ("availability_id", ["availability"]),
    "dim_category": ("category_id", ["category_name"]),
    "dim_rooms_info": ("rooms_info_id", ["bathrooms_number", "bedrooms_number", "total_room_number", "kitchen_status", "garage", "property_floor"]),
    "dim_energy_info": ("energy_info_id", ["is_zero_energy_building", "heating_type", "energy_class", "air_conditioning"]),
    "dim_auction_info": ("auction_info_id", ["auction_end_date", "deposit_modality_hash", "auction_type", "is_open", "minimum_offer", "procedure_number", "auction_court", "lot_category_id", "lot_category_name"]),
    "dim_listing_type": ("listing_type_id", ["listing_type"]),
    "dim_additional_costs": ("additional_costs_id", ["condominium_monthly_expenses", "heating_yearly_expenses", "mortgage_rate", "monthly_payment"]),
    "dim_type_of_property": ("type_of_property_id", ["type_of_property"]),
    "dim_condition": ("condition_id", ["condition"]),
    "dim_building_info": ("building_info_id", ["has_elevator", "building_usage", "building_year", "total_building_floors", "total_number_of_residential_units", "work_start_date", "work_end_date", "work_completion"]),
    "dim_location_info": ("location_info_id", ["latitude", "longitude", "region", "province", "province_code", "city", "macrozone", "microzone"]),
    "dim_cadastral_info": ("cadastral_info_id", ["cadastral", "cadastral_additional_info", "sub_cadastral_info"]),
    "dim_surface_composition": ("surface_composition_id", ["element_name", "element_floor", "element_surface", "percentage", "element_commercial_surface"]),
    "dim_features": ("feature_id", ["feature_name"]),
}

#: Groups of features that a table's columns are made of, where there are any.
GROUPS_OF = {
    "dim_seller_type": ("listing_info",), "dim_listing_info": ("listing_info",), "dim_availability": ("availability",), "dim_category": ("type_of_property", "auction_info"), "dim_rooms_info": ("rooms_info",),
    "dim_energy_info": ("energy_info",), "dim_auction_info": ("auction_info",), "dim_additional_costs": ("price", "additional_costs"), "dim_type_of_property": ("type_of_property",), "dim_condition": ("condition",),
    "dim_building_info": ("building_info",), "dim_location_info": ("location_info",), "dim_cadastral_info": ("cadastral_info",), "dim_surface_composition": ("surface_composition",), "dim_features": ("additional_features",),
    "fact_listing": ("price", "total_surface", "price_per_sq_mt"),
}


def rate_state(snapshots: DataFrame, rate: str = "mortgage_rate", date: str = "scraping_date", kind: str = "listing_type") -> DataFrame:
    """E1's state: sum and number of the rates of sale and auction listings by date. States of parts add up to the whole's.

    Rates are added as decimals, so a sum doesn't depend on the order of rows or on how they are split.
    """
    some = snapshots.where(F.col(kind).isin("sale", "auction") & F.col(rate).isNotNull())
    return some.groupBy(date).agg(F.sum(F.col(rate).cast("decimal(18,9)")).alias("rate_sum"), F.count("*").alias("rate_count"))


def mean_rates(states: DataFrame, date: str = "scraping_date") -> DataFrame:
    """Mean rate by date from one state or several parts' states; keys are made of it, so it is a decimal's."""
    mean = F.sum("rate_sum").cast("decimal(28,9)") / F.sum("rate_count").cast("decimal(10,0)")
    return states.groupBy(date).agg(mean.cast("decimal(22,13)").cast("double").alias("date_rate"))


def adjusted_rates(snapshots: DataFrame, rate: str = "mortgage_rate", date: str = "scraping_date", kind: str = "listing_type") -> DataFrame:
    """Mean rate of sale and auction listings by date; dates without a rate are absent."""
    return mean_rates(rate_state(snapshots, rate, date, kind), date)


def with_payment(snapshots: DataFrame, rates: DataFrame, date: str = "scraping_date") -> DataFrame:
    """The listing's rate or, for sale and auction, the date's; a monthly payment for those with a price.

    rates has a row for each scraping date, and joins as Spark finds best by its size.
    """
    sold = F.col("listing_type").isin("sale", "auction")
    out = snapshots.join(rates, date, "left").withColumn("resolved_rate", F.coalesce("mortgage_rate", F.when(sold, F.col("date_rate"))))
    return out.withColumn("monthly_payment", F.when(sold, numbers.monthly_payment("price", "resolved_rate"))).drop("date_rate")


def energy_class(name: Column | str, plain: Column | str | None = None) -> Column:
    """A class's name in lower case; the plain `a` is `a1`."""
    text = F.lower(F.coalesce(col(name), col(plain)) if plain is not None else col(name))
    return F.when(text == "a", "a1").otherwise(text)


def dates_of(df: DataFrame, column: str = "scraping_date") -> DataFrame:
    """E5"""
    d = dates.to_date(F.col(column).cast("string"))
    found = df.select(d.alias("date_value")).where("date_value is not null").distinct()
    return found.select(key("date_value").alias("date_id"), "date_value", *(c.alias(n) for n, c in dates.date_parts("date_value").items()))


def listing_types(spark) -> DataFrame:
    """The three constants, as a plan of known size: Spark takes rows of Python's for a large table, and facts for the smaller one."""
    return members(spark.range(1).select(F.explode(F.array(*map(F.lit, schemas.LISTING_TYPES))).alias("listing_type")), ["listing_type"], "listing_type_id")


def categories(df: DataFrame, *sources: Column) -> DataFrame:
    """One dimension from several columns."""
    found = reduce(lambda a, b: a.union(b), (df.select(F.lower(s).alias("category_name")) for s in sources))
    return members(found.where("category_name <> ''"), ["category_name"], "category_id")


def snapshot_date(column: str = "scraping_date") -> Column:
    return dates.to_date(F.substring(F.col(column).cast("string"), 1, 10))


def normalised(snapshots: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """The columns of all dimensions, with costs. rates: (date_value, date_rate); the snapshots' own means, if None."""
    return with_costs(plain(snapshots), rates)


def plain(snapshots: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The columns of all dimensions from feature snapshots (listing_id, scraping_date, listing_type, listing_features).

    Costs need the dates' mean rates; see with_costs. carry: other columns to keep. Decimals are cast before keys are made, so float noise can't split members. Groups that are NULL stay apart from
    groups of NULLs by a flag (`has_...`).
    """
    f = F.col("listing_features")
    text = lambda c: F.nullif(F.lower(c), F.lit(""))
    rooms, build, en, loc, auc, cad = (f[g] for g in ("rooms_info", "building_info", "energy_info", "location_info", "auction_info", "cadastral_info"))
    rows = snapshots.where(snapshot_date().isNotNull())
    money = lambda c: numbers.first_number(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).cast("decimal(10,2)")
    return rows.select(
        *carry, "listing_id", "listing_type", snapshot_date().alias("date_value"),
        f["price"].cast("decimal(15,2)").alias("price"), f["total_surface"].cast("decimal(15,2)").alias("surface"), f["price_per_sq_mt"].cast("decimal(15,2)").alias("price_per_sq_mt"),
        text(f["listing_info"]["seller_type"]).alias("seller_type"), f["listing_info"]["listing_age"].alias("listing_age"), f["listing_info"]["listing_last_update"].alias("listing_last_update"), f["listing_info"]["number_of_photos"].alias("number_of_pictures"),
        text(f["availability"]).alias("availability"), F.coalesce(text(f["type_of_property"]["category"]), text(auc["lot_category"]["name"])).alias("category_name"), text(f["type_of_property"]["class"]).alias("type_of_property"), text(f["condition"]).alias("condition"),
        rooms.isNotNull().alias("has_rooms"), rooms["bathrooms_number"].alias("bathrooms_number"), rooms["bedrooms_number"].alias("bedrooms_number"), rooms["total_room_number"].alias("total_room_number"), text(rooms["kitchen_status"]).alias("kitchen_status"), text(rooms["garage"]).alias("garage"), rooms["property_floor"].alias("property_floor"),
        en.isNotNull().alias("has_energy"), en["is_zero_energy_building"].alias("is_zero_energy_building"), text(en["heating_type"]).alias("heating_type"), energy_class(en["energy_class"]).alias("energy_class"), text(en["air_conditioning"]).alias("air_conditioning"),
        auc.isNotNull().alias("has_auction"), dates.to_date(auc["auction_end_date"]).alias("auction_end_date"), text(auc["deposit_modality"]).alias("deposit_modality"), F.sha2(text(auc["deposit_modality"]), 256).alias("deposit_modality_hash"), text(auc["auction_type"]).alias("auction_type"), auc["is_open"].alias("is_open"), auc["minimum_offer"].cast("decimal(15,2)").alias("minimum_offer"),
        text(auc["procedure_number"]).alias("procedure_number"), text(auc["auction_court"]).alias("auction_court"), auc["lot_category"]["id"].alias("lot_category_id"), text(auc["lot_category"]["name"]).alias("lot_category_name"),
        money(f["additional_costs"]["other_costs"]["condominium_expenses"]).alias("condominium_monthly_expenses"), money(f["additional_costs"]["other_costs"]["heating_expenses"]).alias("heating_yearly_expenses"), f["additional_costs"]["mortgage_rate"].alias("own_rate"),
        build.isNotNull().alias("has_building"), build["has_elevator"].alias("has_elevator"), text(build["building_usage"]).alias("building_usage"), build["building_year"].alias("building_year"), build["total_building_floors"].alias("total_building_floors"), build["total_number_of_residential_units"].alias("total_number_of_residential_units"),
        build["work_start_date"].cast("date").alias("work_start_date"), build["work_end_date"].cast("date").alias("work_end_date"), build["work_completion"].cast("float").alias("work_completion"),
        loc.isNotNull().alias("has_location"), loc["latitude"].cast("decimal(9,6)").alias("latitude"), loc["longitude"].cast("decimal(9,6)").alias("longitude"), *(text(loc[c]).alias(c) for c in ("region", "province", "province_code", "city", "macrozone", "microzone")),
        cad.isNotNull().alias("has_cadastral"), text(cad["cadastral"]).alias("cadastral"), text(cad["cadastral_additional_info"]).alias("cadastral_additional_info"), text(cad["sub_cadastral_info"]).alias("sub_cadastral_info"),
        f["additional_features"].alias("features"), f["surface_composition"].alias("surfaces"),
    )


def with_costs(rows: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Rates, payments and the seller type's key, from rows with own_rate."""
    if rates is None:
        rates = adjusted_rates(rows, "own_rate", "date_value")
    priced = with_payment(rows.withColumn("mortgage_rate", F.col("own_rate")), rates, "date_value")
    return priced.withColumns({"mortgage_rate": F.col("resolved_rate").cast("decimal(5,4)"), "monthly_payment": F.col("monthly_payment").cast("decimal(10,2)"), "seller_type_id": F.when(F.col("seller_type").isNotNull(), key("seller_type"))}).drop("resolved_rate")



_GROUPS = {"dim_rooms_info": "has_rooms", "dim_energy_info": "has_energy", "dim_auction_info": "has_auction", "dim_building_info": "has_building", "dim_location_info": "has_location", "dim_cadastral_info": "has_cadastral"}
_SINGLE = ("dim_seller_type", "dim_availability", "dim_category", "dim_type_of_property", "dim_condition")


def fact_keys(space: int | None = None) -> dict[str, Column]:
    """The foreign keys of a fact, computed from its normalised columns."""
    out = {}
    for t, (name, columns) in DIMENSIONS.items():
        if t in ("dim_seller_type", "dim_surface_composition", "dim_features"):
            continue
        k = key(*columns, space=space)
        if t in _SINGLE:
            k = F.when(F.col(columns[0]).isNotNull(), k)
        elif t in _GROUPS:
            k = F.when(F.col(_GROUPS[t]), k)
        out[name] = k
    return out


def surfaces(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The surface elements of each snapshot."""
    floor = numbers.floor_level("e.value.floor")
    of = (*carry, "listing_id", "date_value")
    return rows.select(*of, F.explode("surfaces").alias("name", "value")).select(*of, F.struct(F.struct("value.*").alias("value")).alias("e"), F.lower("name").alias("element_name")).select(
        *of, "element_name", floor.alias("element_floor"), *(F.col(f"e.value.{c}").cast("float").alias(n) for c, n in (("surface", "element_surface"), ("percentage", "percentage"), ("commercial_surface", "element_commercial_surface")))
    )


def feature_rows(rows: DataFrame, features: str = "features", carry: Sequence[str] = ()) -> DataFrame:
    of = (*carry, "listing_id", "date_value")
    return rows.select(*of, F.explode(features).alias("f")).select(*of, F.lower("f").alias("feature_name")).where("feature_name <> ''")


def dimension(rows: DataFrame, table: str) -> DataFrame:
    """One dimension table of normalised rows."""
    name, columns = DIMENSIONS[table]
    if table == "dim_date":
        return dates_of(rows, "date_value")
    if table == "dim_listing_type":
        return listing_types(rows.sparkSession)
    if table == "dim_surface_composition":
        return members(surfaces(rows), columns, name)
    if table == "dim_features":
        return members(feature_rows(rows), columns, name)
    if table == "dim_auction_info":
        plain = ["deposit_modality" if c == "deposit_modality_hash" else c for c in columns]
        return rows.where("has_auction").select(*columns, "deposit_modality").distinct().select(key(*columns).alias(name), *plain, "deposit_modality_hash")
    return members(rows.where(F.col(columns[0]).isNotNull()) if table in _SINGLE else rows.where(_GROUPS[table]) if table in _GROUPS else rows, columns, name)


def dimensions(rows: DataFrame) -> dict[str, DataFrame]:
    """All dimension tables of normalised rows."""
    return {t: dimension(rows, t) for t in DIMENSIONS}


def keyed(rows: DataFrame, table: str, k: Column, exceptions: dict[str, DataFrame] | None) -> DataFrame:
    """The rows with a dimension's key; k, but for members whose key isn't their first hash (a table of few rows)."""
    name, columns = DIMENSIONS[table]
    if not exceptions or table not in exceptions:
        return rows.withColumn(name, k)
    other = exceptions[table].select(F.col("natural").alias("_n"), F.col("key").alias("_k"))
    return rows.withColumn("_n", natural(*columns)).join(other, "_n", "left").withColumn(name, F.when(k.isNotNull(), F.coalesce("_k", k))).drop("_n", "_k")


def facts(rows: DataFrame, exceptions: dict[str, DataFrame] | None = None, space: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each listing and date, with its foreign keys; no join is needed.

    exceptions: of dimensions with members whose key isn't their first hash, (natural, key). carry: other columns to keep.
    """
    found, out = fact_keys(space), rows
    names = list(found)
    for table in exceptions or ():
        if (name := DIMENSIONS[table][0]) in found:
            out = keyed(out, table, found.pop(name), exceptions)
    return out.select("listing_id", *(found[n].alias(n) if n in found else F.col(n) for n in names), "price", "surface", "price_per_sq_mt", *carry).dropDuplicates(["listing_id", "date_id"])


def feature_bridge(rows: DataFrame, exceptions: dict[str, DataFrame] | None = None, space: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """E14"""
    return _bridge(feature_rows(rows, carry=carry), "dim_features", exceptions, space, carry)


def surface_bridge(rows: DataFrame, exceptions: dict[str, DataFrame] | None = None, space: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """E15"""
    return _bridge(surfaces(rows, carry), "dim_surface_composition", exceptions, space, carry)


def _bridge(rows: DataFrame, table: str, exceptions: dict[str, DataFrame] | None, space: int | None, carry: Sequence[str]) -> DataFrame:
    name, columns = DIMENSIONS[table]
    rows = keyed(keyed(rows, table, key(*columns, space=space), exceptions), "dim_date", key("date_value", space=space), exceptions)
    return rows.select("listing_id", "date_id", name, *carry).distinct()


def load_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table."""
    parts = (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in sorted(tables.items()))
    return reduce(lambda a, b: a.union(b), parts)


def integrity(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Violations of each foreign key."""
    parts = (orphans(fact, dims[t], DIMENSIONS[t][0]).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in sorted(dims) if DIMENSIONS[t][0] in fact.columns)
    return reduce(lambda a, b: a.union(b), parts)


def uniqueness(dims: dict[str, DataFrame]) -> DataFrame:
    """Natural keys and surrogate keys that occur more than once."""
    parts = []
    for t, df in sorted(dims.items()):
        for kind, columns in (("natural", DIMENSIONS[t][1]), ("surrogate", [DIMENSIONS[t][0]])):
            parts.append(duplicates(df, columns).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), F.lit(kind).alias("key_kind"), "n"))
    return reduce(lambda a, b: a.union(b), parts)
