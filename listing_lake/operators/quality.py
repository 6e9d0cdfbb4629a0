"""Snapshot history and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col
from ..functions.strings import cleaned

MOST_PER_SQM = 50_000


def exploded(raw: DataFrame, data: str = "data") -> DataFrame:
    """One row for each snapshot of a listing's history, with its place in it."""
    return raw.select("*", F.posexplode(data).alias("version", "_s")).select("*", "_s.*").drop("_s", data)


def latest(df: DataFrame, key: str = "listing_id", order: str = "scraping_date") -> DataFrame:
    """The last version of each key, whole rows; of equal versions the largest row."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_b"))
    return best.select(key, "_b.*").select(*df.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("listing_id", "scraping_date")) -> DataFrame:
    """Incoming rows whose keys aren't stored, each key once; running it again adds nothing.

    Both sides lie by their keys already, so they merge without another move; Spark sizes keys of a stored table by its
    compressed files, and might send them all through the driver.
    """
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys).distinct().hint("merge"), list(keys), "left_anti")


def without_empty_children(df: DataFrame, children: str = "child_listings") -> DataFrame:
    """D3: an empty list becomes NULL; `fixed` tells where."""
    empty = F.coalesce(F.size(children) == 0, F.lit(False)) & F.col(children).isNotNull()
    return df.withColumn("fixed", empty).withColumn(children, F.when(~F.col("fixed"), F.col(children)))


def messages(price: Column | str, surface: Column | str, per_sqm: Column | str, latitude: Column | str, longitude: Column | str, located: Column | str) -> Column:
    """What is wrong with a listing."""
    p, s, q = col(price), col(surface), col(per_sqm)
    rules = [
        (p.isNull(), "missing price"), (p <= 0, "invalid price"), (s.isNull(), "missing surface"), (s <= 0, "invalid surface"),
        (col(located).isNotNull() & (col(latitude).isNull() | col(longitude).isNull()), "missing coordinates"), (q > MOST_PER_SQM, "suspicious price per square metre"),
    ]
    return F.filter(F.array(*(F.when(rule, F.lit(text)) for rule, text in rules)), lambda m: m.isNotNull())


def valid(df: DataFrame, price: str | None = "price", surface: str | None = "surface", latitude: str | None = "latitude") -> DataFrame:
    """Rows that have what is required; None switches a requirement off."""
    return df.dropna(subset=[c for c in (price, surface, latitude) if c])


def clean_fields(df: DataFrame, struct: str = "text_info", fields: tuple[str, ...] = ("title", "caption", "description")) -> DataFrame:
    """D7"""
    out = F.col(struct)
    for f in fields:
        out = out.withField(f, cleaned(F.col(struct)[f]))
    return df.withColumn(struct, out)


def counts(df: DataFrame, by: str = "listing_type", total: str = "total") -> DataFrame:
    """Rows by type, and all."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).alias("_g")).select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(by)).alias(by), "n")


def counts_by_province(df: DataFrame, province: str = "province") -> DataFrame:
    """Most first; the empty name is dropped."""
    return df.where(F.col(province) != "").groupBy(province).agg(F.count("*").alias("n")).orderBy(F.desc("n"), province)


def latest_dates(df: DataFrame, province: str = "province", date: str = "scraping_date") -> DataFrame:
    """Newest first."""
    return df.groupBy(province).agg(F.max(date).alias("latest")).orderBy(F.desc("latest"), province)


def leaves(df: DataFrame, children: str = "child_listings") -> DataFrame:
    """Listings without sub-listings."""
    return df.where(F.col(children).isNull())


def first_per_group(df: DataFrame, n: int, group: str = "listing_type", order: str = "listing_id") -> DataFrame:
    """At most n rows of each group by order (the feature is the cap)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def price_band(price: Column | str, low: float, high: float, step: float) -> Column:
    """0 below low, then bands of width step, the last one open from high on."""
    n = int((high - low) // step) + 1
    p = col(price)
    return F.when(p < low, 0).when(p >= high, n + (0 if (high - low) % step == 0 else 1)).otherwise(F.floor((p - low) / step).cast("int") + 1)


RENT_BANDS, OTHER_BANDS = (200, 5000, 400), (50_000, 1_000_000, 50_000)


def band_counts(df: DataFrame, price: str = "price", kind: str = "listing_type") -> DataFrame:
    """Listings by type and price band."""
    band = F.when(F.col(kind) == "rent", price_band(price, *RENT_BANDS)).otherwise(price_band(price, *OTHER_BANDS))
    return df.where(F.col(price).isNotNull()).groupBy(kind, band.alias("band")).agg(F.count("*").alias("n"))
