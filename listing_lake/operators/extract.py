"""Typed features out of a listing page's payload, each group a projection; built-in expressions only.

`features(snapshots)` takes (listing_id, scraping_date, html_source, parent_listing, child_listings) and adds the
struct listing_features; a page that can't be parsed has it all NULL. With `only`, the groups that are named are
read, by a schema of just the fields that they need: the JSON parser skips the rest of the payload.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import dates, numbers, strings
from ..functions.numbers import col
from ..sources import tables
from .pages import payload


def real_estate(json: Column | str, listing: Sequence[str] | None = None, properties: Sequence[str] | None = None) -> Column:
    """The listing's part of the payload; NULL where it is missing or malformed.

    listing, properties: the fields of the listing and of its properties that are read; all, if None.
    """
    some = lambda fields, names: [f for f in fields if names is None or f.name in names]
    estate = T.StructType(some(T.StructType.fromDDL(schemas.REAL_ESTATE).fields, listing))
    estate.add("properties", T.ArrayType(T.StructType(some(T.StructType.fromDDL(schemas.PROPERTY).fields, properties))))
    kind = estate
    for name in ("realEstate", "detailData", "pageProps", "props"):
        kind = T.StructType().add(name, kind)
    return F.from_json(col(json), kind, {"mode": "PERMISSIVE"})["props"]["pageProps"]["detailData"]["realEstate"]


def listing_age(created: Column, scraped: Column) -> Column:
    """X2"""
    return F.datediff(scraped.cast("date"), dates.epoch_date(created))


def last_update_age(text: Column, scraped: Column) -> Column:
    """X3"""
    return F.datediff(scraped.cast("date"), dates.last_word_date(text))


def seller_type(advertiser: Column) -> Column:
    """The agency's label, `privato` without an agency, NULL without an advertiser."""
    return F.when(advertiser.isNull(), None).when(advertiser["agency"].isNotNull(), advertiser["agency"]["label"]).otherwise("privato")


def photo_count(photos: Column) -> Column:
    """X6"""
    return F.when(photos.isNotNull(), F.size(photos))


def mortgage_rate(rates: Column, percent: int = 80, year: int = 30) -> Column:
    """The rate of one loan share and term; the first, if several."""
    inner = F.flatten(F.transform(F.filter(rates, lambda r: r["percent"] == percent), lambda r: r["rates"]))
    return F.try_element_at(F.filter(inner, lambda r: r["year"] == year), F.lit(1))["rate"]


def surface_composition(elements: Column) -> Column:
    """A map by element name; of elements with one name the last one counts, unnamed ones are dropped."""
    area = lambda text: numbers.surface(text, F.lit(None).cast("string"))
    value = lambda e: F.struct(
        e["floor"]["value"].alias("floor"),
        area(e["surface"]).alias("surface"),
        e["percentage"].alias("percentage"),
        area(e["commercialSurface"]).alias("commercial_surface"),
        e["surfaceType"].alias("surface_type"),
    )
    named = F.transform(F.filter(elements, lambda e: e["constitution"].isNotNull()), lambda e: F.struct(e["constitution"].alias("key"), value(e).alias("value")))
    entry = "struct<floor: string, surface: double, percentage: double, commercial_surface: double, surface_type: string>"
    kind = f"array<struct<key: string, value: {entry}>>"
    last = F.aggregate(named, F.array().cast(kind), lambda done, e: F.concat(F.filter(done, lambda d: d["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def energy(e: Column) -> Column:
    """X13"""
    return F.struct(
        e["zeroEnergyBuilding"].alias("is_zero_energy_building"),
        strings.lower(e["heatingType"]).alias("heating_type"),
        strings.lower(e["class"]).alias("energy_class"),
        numbers.consumption(e["epi"]).alias("energy_consumption"),
        strings.lower(e["airConditioning"]).alias("air_conditioning"),
    )


def location(x: Column) -> Column:
    """X14"""
    key = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    same = ("city", "macrozone", "microzone", "locality", "address")
    return F.struct(
        x["latitude"].alias("latitude"),
        x["longitude"].alias("longitude"),
        key(x["region"]).alias("region"),
        key(x["province"]).alias("province"),
        x["provinceId"].alias("province_code"),
        *(x[c].alias(c) for c in same),
        x["streetNumber"].alias("street_number"),
    )


def building(p: Column, scraped: Column, work: Column) -> Column:
    """X15. work: start and end of the works."""
    start, end = work["start"], work["end"]
    return F.struct(
        p["elevator"].alias("has_elevator"),
        strings.lower(p["buildingUsage"]["value"]).alias("building_usage"),
        numbers.room_range(p["buildingYear"]).alias("building_year"),
        numbers.first_number(p["floors"]).cast("int").alias("total_building_floors"),
        numbers.first_number(p["residentialUnits"]).cast("int").alias("total_number_of_residential_units"),
        start.cast("string").alias("work_start_date"),
        end.cast("string").alias("work_end_date"),
        dates.completion(start, end, scraped).alias("work_completion"),
        p["workProgress"].alias("work_progress"),
    )


def auction(a: Column) -> Column:
    """X16"""
    return F.struct(
        a["saleDateValue"].alias("auction_end_date"),
        a["modalityDeposit"].alias("deposit_modality"),
        a["saleType"].alias("auction_type"),
        a["saleState"]["isAvailable"].alias("is_open"),
        numbers.whole_amount(a["minimumOffer"]).alias("minimum_offer"),
        a["procedureNumber"].alias("procedure_number"),
        a["auctionCourt"].alias("auction_court"),
        a["lotCategory"].alias("lot_category"),
    )


def cadastral(items: Column) -> Column:
    """The first entry only."""
    first = F.try_element_at(items, F.lit(1))
    return F.struct(
        first["cadastral"].alias("cadastral"),
        first["cadastralInfo"].alias("cadastral_additional_info"),
        first["subCadastral"].alias("sub_cadastral_info"),
    )


def listing_info(r: Column, p: Column, on: Column) -> Column:
    """X2 to X6"""
    return F.struct(
        listing_age(r["createdAt"], on).alias("listing_age"),
        last_update_age(p["lastUpdate"], on).alias("listing_last_update"),
        r["isNew"].alias("is_listing_new"),
        F.col("parent_listing").isNotNull().alias("has_parent"),
        F.col("child_listings").isNotNull().alias("has_child"),
        seller_type(r["advertiser"]).alias("seller_type"),
        photo_count(p["multimedia"]["photos"]).alias("number_of_photos"),
    )


def additional_costs(r: Column, p: Column) -> Column:
    costs = F.struct(p["costs"]["condominiumExpenses"].alias("condominium_expenses"), p["costs"]["heatingExpenses"].alias("heating_expenses"))
    return F.struct(costs.alias("other_costs"), mortgage_rate(r["mortgage"]["mortgageWidget"]["rates"]).alias("mortgage_rate"))


def property_type(r: Column, p: Column) -> Column:
    """X10"""
    return F.struct(strings.lower(p["typologyValue"]).alias("class"), strings.lower(p["category"]["name"]).alias("category"), r["luxury"].alias("is_luxury"))


def rooms(p: Column) -> Column:
    """X10 to X12"""
    return F.struct(
        numbers.room_count(p["bathrooms"]).alias("bathrooms_number"),
        numbers.room_range(p["bedRoomsNumber"]).alias("bedrooms_number"),
        numbers.room_range(p["rooms"]).alias("total_room_number"),
        strings.lower(p["roomsValue"]).alias("rooms_description"),
        strings.lower(p["kitchenStatus"]).alias("kitchen_status"),
        p["garage"].alias("garage"),
        numbers.property_floor(p["floor"]["abbreviation"], p["floor"]["floorOnlyValue"]).alias("property_floor"),
    )


@dataclass(frozen=True)
class Group:
    """A group of features: (listing, property, date) to a column, and the payload's fields and steps that it reads."""

    make: Callable[[Column, Column, Column], Column]
    properties: tuple[str, ...] = ()
    listing: tuple[str, ...] = ()
    steps: tuple[str, ...] = ()


def _work(p: Column) -> Column:
    start, end = dates.work_dates(p["workDates"])
    return F.struct(start.alias("start"), end.alias("end"))


#: Values that a group reads several times: columns of a projection of their own, so that each is worked out once.
STEPS: dict[str, Callable[[Column], Column]] = {"_area": lambda p: numbers.surface(p["surface"], p["surfaceValue"]), "_work": _work}


GROUPS: dict[str, Group] = {
    "price": Group(lambda r, p, on: p["price"]["value"], ("price",)),
    "total_surface": Group(lambda r, p, on: F.col("_area"), ("surface", "surfaceValue"), steps=("_area",)),
    "price_per_sq_mt": Group(lambda r, p, on: numbers.price_per_sqm(p["price"]["value"], "_area"), ("price", "surface", "surfaceValue"), steps=("_area",)),
    "listing_info": Group(listing_info, ("lastUpdate", "multimedia"), ("createdAt", "isNew", "advertiser")),
    "additional_costs": Group(lambda r, p, on: additional_costs(r, p), ("costs",), ("mortgage",)),
    "auction_info": Group(lambda r, p, on: F.when(p["auction"].isNotNull(), auction(p["auction"])), ("auction",)),
    "cadastral_info": Group(lambda r, p, on: F.when(F.size(p["cadastrals"]) > 0, cadastral(p["cadastrals"])), ("cadastrals",)),
    "surface_composition": Group(lambda r, p, on: surface_composition(p["surfaceConstitution"]["surfaceConstitutionElements"]), ("surfaceConstitution",)),
    "availability": Group(lambda r, p, on: p["availability"], ("availability",)),
    "type_of_property": Group(lambda r, p, on: property_type(r, p), ("typologyValue", "category"), ("luxury",)),
    "condition": Group(lambda r, p, on: strings.lower(p["condition"]), ("condition",)),
    "rooms_info": Group(lambda r, p, on: rooms(p), ("bathrooms", "bedRoomsNumber", "rooms", "roomsValue", "kitchenStatus", "garage", "floor")),
    "additional_features": Group(lambda r, p, on: p["ga4features"], ("ga4features",)),
    "building_info": Group(
        lambda r, p, on: building(p, on, F.col("_work")), ("elevator", "buildingUsage", "buildingYear", "floors", "residentialUnits", "workDates", "workProgress"), steps=("_work",)
    ),
    "energy_info": Group(lambda r, p, on: F.when(p["energy"].isNotNull(), energy(p["energy"])), ("energy",)),
    "location_info": Group(lambda r, p, on: F.when(p["location"].isNotNull(), location(p["location"])), ("location",)),
    "text_info": Group(
        lambda r, p, on: F.struct(r["title"].alias("title"), p["caption"].alias("caption"), p["description"].alias("description")),
        ("caption", "description"), ("title",),
    ),
}


def features(snapshots: DataFrame, html: str = "html_source", scraped: str = "scraping_date", only: Sequence[str] | None = None) -> DataFrame:
    """X1 to X19 for every snapshot: all groups of features, or those named."""
    tables.small_methods(snapshots.sparkSession)
    named = {name: GROUPS[name] for name in (GROUPS if only is None else only)}
    listing, properties = ({f for g in named.values() for f in getattr(g, part)} for part in ("listing", "properties"))
    # an element of which no field is asked for would be indistinguishable from a missing one
    read = real_estate(payload(html), None if only is None else sorted(listing), None if only is None else sorted(properties | {"price"}))
    steps = sorted({f for g in named.values() for f in g.steps})
    rows = snapshots.withColumn("_r", read).withColumn("_p", F.try_element_at(F.col("_r")["properties"], F.lit(1)))
    r, p, on = F.col("_r"), F.col("_p"), F.col("_on")
    rows = rows.withColumns({"_on": dates.to_date(F.substring(F.col(scraped).cast("string"), 1, 10)), **{s: STEPS[s](p) for s in steps}})
    group = F.struct(*(g.make(r, p, on).alias(name) for name, g in named.items()))
    return rows.withColumn("listing_features", F.when(p.isNotNull(), group)).drop("_r", "_p", "_on", *steps)
