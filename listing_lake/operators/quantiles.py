"""Exact quantiles by selection of ranks, for whole tables and for groups, without a task that has all values.

Distinct values are counted, with partial counts before the shuffle, and written; a value that a third of all rows has is one row
then. While the values between which a rank lies are more than `most`, a pass counts them in `bins` ranges of
equal width and keeps, for each rank, the range that it falls into; each range's own least and greatest values bound the
next pass. What is left, at most `most` distinct values for each rank, is put in order in a window, one rank
each. So a task's state is bounded by `bins` or `most`, whatever the table's size or skew; three passes divide a range by ten billion.

Interpolation is linear, as the built-in `percentile` has it. NULL and NaN are no values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), bins: int = 2048, most: int = 65_536) -> DataFrame:
    """(by..., a column q_<name> for each column: the array of its quantiles in the order of the shares).

    Without `by` there is one row; with it, one for each group (NULL is a group) in which a column has a value. A column
    without values has NULLs.
    """
    by = list(by)
    number = lambda c: F.col(c).cast("double")
    stacked = df.select(*by, F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), F.when(~F.isnan(number(c)), number(c)).alias("_v")) for i, c in enumerate(columns)))))
    counts = scratch.kept(stacked.where("_v IS NOT NULL").groupBy(*by, "_i", "_v").agg(F.count("*").alias("_n")))
    of = [*by, "_i"]
    ranges = [F.sum("_n").alias("_all"), F.count("*").alias("_different"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    whole = counts.groupBy(*of).agg(*ranges)
    at = [F.struct(F.lit(j).alias("_j"), (F.lit(float(s)) * (F.col("_all") - 1)).alias("_at")) for j, s in enumerate(shares)]
    ranks = whole.select("*", F.inline(F.array(*at))).select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    ranks = ranks.withColumn("_below", F.lit(0).cast("long"))
    while (ranks := scratch.kept(ranks)).where(F.col("_different") > most).limit(1).count():
        ranks = narrowed(counts, ranks, of, bins, most)
    found = selected(counts, ranks, of)
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    value = F.when(low == high, low).otherwise((F.max("_rank") - F.max("_at")) * low + (F.max("_at") - F.min("_rank")) * high)
    each = found.groupBy(*of, "_j").agg(value.alias("_q"))
    named = lambda i, j: F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("_q")))
    return each.groupBy(*by).agg(*(F.array(*(named(i, j) for j in range(len(shares)))).alias(f"q_{c}") for i, c in enumerate(columns)))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"r{c}"]) for c in columns))


def _within(counts: DataFrame, ranks: DataFrame, of: Sequence[str]) -> DataFrame:
    """The values in each rank's range, with the rank's columns. ranks has some rows for each group and column."""
    named = ranks.select(*(F.col(c).alias(f"r{c}") if c in of else F.col(c) for c in ranks.columns))
    return counts.join(named, _same(counts, named, of) & counts["_v"].between(named["_low"], named["_high"])).drop(*(f"r{c}" for c in of))


def _reached(rows: DataFrame, key: Sequence[str], order: str, n: str) -> DataFrame:
    """Of rows in order, for each key, the first up to which more than `_rank` values lie."""
    up_to = F.sum(n).over(Window.partitionBy(*key).orderBy(order))
    rows = rows.withColumn("_up_to", F.col("_below") + up_to).where("_up_to > _rank")
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_first = 1").withColumn("_below", F.col("_up_to") - F.col(n)).drop("_up_to", "_first")


def narrowed(counts: DataFrame, ranks: DataFrame, of: Sequence[str], bins: int, most: int) -> DataFrame:
    """Ranks with their ranges cut to one of `bins` parts; those with few enough values stay as they are."""
    some, rest = ranks.where(F.col("_different") > most), ranks.where(F.col("_different") <= most)
    width = F.col("_high") - F.col("_low")
    part = F.when(F.abs("_v") == math.inf, F.when(F.col("_v") > 0, bins + 1).otherwise(-1)).when(width == math.inf, F.floor((F.signum("_v") + 1) * bins / 2)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / width * bins)))
    key = [*of, "_j", "_rank"]
    inside = _within(counts, some, of).withColumn("_part", part.cast("int"))
    hist = inside.groupBy(*key, "_at", "_all", "_below", "_part").agg(F.sum("_n").alias("_c"), F.count("*").alias("_different"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return _reached(hist, key, "_part", "_c").select(*ranks.columns).unionByName(rest)


def selected(counts: DataFrame, ranks: DataFrame, of: Sequence[str]) -> DataFrame:
    """Each rank's value."""
    key = [*of, "_j", "_rank"]
    return _reached(_within(counts, ranks, of).select(*key, "_at", "_below", "_v", "_n"), key, "_v", "_n")
