"""Cleaning and imputation of the wide frame. Medians are taken over all rows, before any are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import before_separator, looked_up
from .quantiles import quantiles

NUMERIC = ("price", "surface", "condominium_monthly_expenses", "heating_yearly_expenses", "total_room_number", "bathrooms_number", "floor", "building_year", "latitude", "longitude")
#: The columns that are not categories.
NUMERIC_ROLE = ("listing_id", "price", "surface", "condominium_monthly_expenses", "heating_yearly_expenses", "building_year", "latitude", "longitude")
#: Energy classes from best to worst.
ENERGY_ORDER = {"a4": 1, "a3": 2, "a2": 3, "a1": 4, "a+": 4, "b": 5, "c": 6, "d": 7, "e": 8, "f": 9, "g": 10}
#: Spellings of property types.
PROPERTY_SPELLINGS = {
    "attic - attic": "attic",
    "mansarda": "attic",
    "": "unknown",
    "♪": "unknown",
    "holiday in villa": "vacation villa",
    "vacation in villa": "vacation villa",
    "holiday in apartment": "vacation apartment",
    "holiday in the house for holidays": "vacation house",
    "holiday home for holidays": "vacation house",
    "holiday home": "vacation house",
    "vacation in the house for holidays": "vacation house",
    "holidays in bed & breakfast": "bed & breakfast",
    "holidays in farmhouse": "vacation farmhouse",
    "holidays in residence": "vacation residence",
    "warehouse or warehouse": "warehouse",
    "land - agricultural land": "agricultural land",
    "estate or estate": "estate",
    "rustic - building land residential": "rustic",
    "historical abode": "historical residence",
    "warehouse or storage": "storage",
}


def medians(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row with the median of each column: exact by selection of ranks, or in one pass."""
    if approximate:
        return df.agg(*(F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"_m_{c}") for c in columns))
    return quantiles(df, columns, [0.5]).select(*(F.col(f"q_{c}")[0].alias(f"_m_{c}") for c in columns))


def impute(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """H1: NULL becomes the column's median; the medians are one row, which is broadcast."""
    m = medians(df, columns, approximate)
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c).cast("double"), f"_m_{c}") for c in columns}).drop(*m.columns)


def fix_negative(df: DataFrame, column: str = "building_year", approximate: bool = False) -> DataFrame:
    """H2: negative values become the median."""
    m = medians(df, [column], approximate)
    return df.crossJoin(F.broadcast(m)).withColumn(column, F.when(F.col(column) < 0, F.col(f"_m_{column}")).otherwise(F.col(column).cast("double"))).drop(*m.columns)


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """H3"""
    return df.fillna("unknown", list(columns))


def as_flag(c: Column) -> Column:
    """H4: true is 1, false and NULL 0."""
    return F.coalesce(c.cast("int"), F.lit(0))


def present(c: Column) -> Column:
    """H5"""
    return c.isNotNull().cast("int")


def energy_rank(c: Column) -> Column:
    """H6 without the median for what isn't mapped."""
    return looked_up(c, ENERGY_ORDER).cast("double")


def property_type(c: Column) -> Column:
    """H7: the text before the bar in its usual spelling."""
    head = F.when(c.isNotNull(), before_separator(c))
    return looked_up(head, PROPERTY_SPELLINGS, head)


def complete(df: DataFrame, columns: Sequence[str] = ("price", "region", "province")) -> DataFrame:
    """H8"""
    return df.dropna(subset=list(columns))


def in_country(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """H9: within the bounding box; rows without coordinates go."""
    return df.where(F.col(longitude).between(6, 19) & F.col(latitude).between(35, 48))


def roles(df: DataFrame, numeric: Sequence[str] = NUMERIC_ROLE) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns."""
    return [c for c in numeric if c in df.columns], [c for c in df.columns if c not in numeric]


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    """H11"""
    return df.drop(*columns)


def prepared(df: DataFrame, fill_numeric: bool = True, spurious: Sequence[str] = (), unknown: Sequence[str] = ("seller_type", "condition", "kitchen_status", "heating_type", "air_conditioning"), approximate: bool = False) -> DataFrame:
    """All steps in order, of the columns that are there."""
    out = drop_if_present(df, *spurious)
    have = lambda names: [c for c in names if c in out.columns]
    if fill_numeric and have(NUMERIC):
        out = impute(out, have(NUMERIC), approximate)
    if have(["building_year"]):
        out = fix_negative(out, approximate=approximate)
    out = fill_unknown(out, have(unknown))
    out = out.withColumns({c: as_flag(F.col(c)) for c in have(("has_elevator", "is_zero_energy"))} | {c: present(F.col(c)) for c in have(["garage"])})
    if have(["energy_class"]):
        out = impute(out.withColumn("energy_class", energy_rank(F.col("energy_class"))), ["energy_class"], approximate)
    if have(["type_of_property"]):
        out = out.withColumn("type_of_property", property_type(F.col("type_of_property")))
    return in_country(complete(out))
