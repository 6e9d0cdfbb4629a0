"""Rent summaries, yields and pipeline status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def _summary(df: DataFrame, group: str, value: str, *others: str) -> DataFrame:
    """A row for each group: moments of the value, its median, and mean and median of the other columns."""
    r = lambda x: F.bround(x, 2)
    df = df.where(F.col(group).isNotNull()).select(group, *(F.col(c).cast("double").alias(c) for c in (value, *others)))
    medians = quantiles(df, [value, *others], [0.5], [group])
    moments = [r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"), F.count(value).alias("count")]
    rows = df.groupBy(group).agg(*moments, *(r(F.avg(c)).alias(f"mean_{c}") for c in others)).join(medians, group, "left")
    more = [x for c in others for x in (F.col(f"mean_{c}"), r(F.col(f"q_{c}")[0]).alias(f"median_{c}"))]
    return rows.select(group, "mean", r(F.col(f"q_{value}")[0]).alias("median"), "std", "min", "max", "count", *more)


def by_region(df: DataFrame, value: str = "predicted_rent", region: str = "region") -> DataFrame:
    """Mean first; a single row's deviation is NULL, a NULL region is dropped."""
    return _summary(df, region, value).orderBy(F.desc("mean"), region)


def by_listing_type(df: DataFrame, value: str = "predicted_rent", price: str = "price", kind: str = "listing_type") -> DataFrame:
    """J21"""
    return _summary(df, kind, value, price).withColumnsRenamed({f"mean_{price}": "mean_price", f"median_{price}": "median_price"}).orderBy(kind)
