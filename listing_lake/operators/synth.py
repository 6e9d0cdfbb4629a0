"""Synthetic rows by nearest-neighbour interpolation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources import scratch

EPSILON = 1e-6


def scales(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean and the population deviation of each column (1 for a constant one)."""
    return df.agg(*(F.avg(c).alias(f"_a_{c}") for c in columns), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in columns))


def standardised(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Columns as deviations from their mean; the scales are one row, which is broadcast."""
    m = scales(df, columns)
    return df.crossJoin(F.broadcast(m)).withColumns({f"{prefix}{c}": (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*m.columns)


def restored(df: DataFrame, scale: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """The inverse."""
    return df.crossJoin(F.broadcast(scale)).withColumns({c: F.col(f"{prefix}{c}") * F.col(f"_s_{c}") + F.col(f"_a_{c}") for c in columns}).drop(*scale.columns)


def domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, place): each categorical column's values in order.

    Values are ordered in ranges over all partitions; a value's place is what its range has before it, plus the counts
    of the ranges before: a row for each partition and column, so no task has all values.
    """
    parts = (df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")).where("value is not null").distinct() for c in columns)
    all_ = reduce(lambda a, b: a.union(b), parts).orderBy("column_name", "value").withColumn("_p", F.spark_partition_id())
    all_ = scratch.kept(all_)  # a sort that is made twice may have other ranges
    before = Window.partitionBy("column_name").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = all_.groupBy("_p", "column_name").agg(F.count("*").alias("_c")).withColumn("_o", F.sum("_c").over(before))
    within = all_.withColumn("_w", F.row_number().over(Window.partitionBy("_p", "column_name").orderBy("value")))
    placed = within.join(F.broadcast(offsets), ["_p", "column_name"])
    return placed.select("column_name", "value", (F.coalesce("_o", F.lit(0)) + F.col("_w")).cast("int").alias("place"))


def seeds(df: DataFrame, n: int, row_id: str, seed: int = 2025) -> DataFrame:
    """N rows drawn with replacement: (seed_id, row_id). Row numbers come from an exact rank by id in ranges.

    Rows are ordered by id over all partitions; a partition's offset is a count, so no task sees all rows.
    """
    total = df.count()
    if not total:
        return df.select(F.lit(0).cast("long").alias("seed_id"), row_id).limit(0)
    drawn = df.sparkSession.range(n).select(F.col("id").alias("seed_id"), F.floor(F.rand(seed) * total).cast("long").alias("_n"))
    return drawn.join(numbered(df.select(row_id), row_id), "_n").select("seed_id", row_id)


def numbered(df: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """A row number from 0 in the order of a column, without one task for all rows."""
    parts = scratch.kept(df.orderBy(order).withColumn("_p", F.spark_partition_id()))  # a sort that is made twice may have other ranges
    offsets = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    within = parts.withColumn("_w", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return within.join(F.broadcast(offsets), "_p").withColumn(name, F.coalesce("_o", F.lit(0)) + F.col("_w")).drop("_p", "_c", "_o", "_w")


#: Numbers in the largest matrix that a task makes at once, whatever the numbers of rows, queries and cells are.
NUMBERS = 1 << 20


def _step(width: int) -> int:
    """How many rows of that width are one matrix."""
    return max(1, NUMBERS // max(1, width))


def nearest_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the k nearest rows of each query, ties to the smaller id.

    A product of matrices tells which rows can be among the k; these distances are then taken term by term.
    """
    found: list[tuple[np.ndarray, ...]] = []
    norms = (rows * rows).sum(axis=1)
    step = _step(len(rows))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        own_norms = (q * q).sum(axis=1)
        near = own_norms[:, None] + norms[None, :] - 2 * (q @ rows.T)
        slack = 1e-9 * (own_norms[:, None] + norms[None, :] + 1)
        if own is not None:
            near[own[at : at + step, None] == ids[None, :]] = np.inf
        last = np.partition(near + slack, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(q), np.inf)
        i, j = np.nonzero((near - slack <= last[:, None]) & (near < np.inf))
        d2 = ((q[i] - rows[j]) ** 2).sum(axis=1)
        order = np.lexsort((ids[j], d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[keep] + at, j[keep], d2[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def _meet(queries: DataFrame, rows: DataFrame, on: Sequence[str], k: int, exclude_self: bool, rows_per_block: int, queries_per_block: int) -> DataFrame:
    """(q, r, d2): of the rows with equal columns `on`, the k nearest of each query or more.

    Both: (id, v, on...). What has one key is dealt into blocks of bounded size on both sides; a task takes one block
    of each as Arrow columns and leaves k rows for each query.
    """
    on = list(on)
    parts = lambda df, most, name: df.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = parts(queries, queries_per_block, "_q").join(parts(rows, rows_per_block, "_d"), on)  # one row for each key
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, on).select(*on, "id", "v", dealt("_q").alias("_p"), every("_d").alias("_b"))
    d = rows.join(sizes, on).select(*on, "id", "v", every("_q").alias("_p"), dealt("_d").alias("_b"))
    schema = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("d2", pa.float64())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asked, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        i, j, d2 = nearest_rows(_matrix(left.column("v")), _matrix(right.column("v")), ids, asked if exclude_self else None, k)
        return pa.Table.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(d2)], schema=schema)

    key = [*on, "_p", "_b"]
    return q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(work, "q long, r long, d2 double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Of each query's rows the k nearest, ties to the smaller id, with ranks."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "r"))).where(F.col("rank") <= k)


class Boxes:
    """The cells' pivots, boxes and numbers of rows."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.count = pivots, np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full(pivots.shape, np.inf), np.full(pivots.shape, -np.inf)

    def gaps(self, v: np.ndarray) -> np.ndarray:
        """Squared distances from points to boxes; infinite to a cell without rows."""
        out = np.zeros((len(v), len(self.pivots)))
        for j in range(v.shape[1]):
            x = v[:, j, None]
            out += np.maximum(0, np.maximum(self.low[:, j] - x, x - self.high[:, j])) ** 2
        return out

    def nearest(self, v: np.ndarray) -> np.ndarray:
        norms, step = (self.pivots * self.pivots).sum(axis=1), _step(len(self.pivots))
        return np.concatenate([(norms - 2 * v[at : at + step] @ self.pivots.T).argmin(axis=1) for at in range(0, len(v), step)])

    def first(self, least: int) -> list[list[int]]:
        """For each cell the cells nearest to its pivot, itself first, that have `least` rows together (or all rows)."""
        out = []
        for i, gap in enumerate(self.gaps(self.pivots)):
            gap[i] = -1
            order = np.argsort(gap, kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.count[order]), least)) + 1
            out.append([int(c) for c in order[:enough] if self.count[c]])
        return out


class Cells:
    """Rows by their nearest pivot, with the cells' boxes; there are at most `most` cells."""

    def __init__(self, data: DataFrame, rows_per_cell: int, most: int, seed: int = 0):
        n = max(1, min(most, -(-data.count() // rows_per_cell)))
        self.boxes = Boxes(np.array([r.v for r in data.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("v").limit(n).collect()], float))
        self.rows = scratch.kept(self.placed(data))
        sides = self.rows.select("cell", F.posexplode("v").alias("at", "x")).groupBy("cell", "at")
        for r in sides.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect():  # a row for each cell and dimension
            self.boxes.low[r.cell, r.at], self.boxes.high[r.cell, r.at], self.boxes.count[r.cell] = r.low, r.high, r.n

    def placed(self, df: DataFrame) -> DataFrame:
        """(id, v, cell)"""
        if not len(self.boxes.pivots):
            return df.select("id", "v", F.lit(0).alias("cell"))
        boxes = Boxes(self.boxes.pivots)

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(boxes.nearest(_matrix(batch.column(1))).astype(np.int32))], names=["id", "v", "cell"])

        return df.select("id", "v").mapInArrow(work, "id long, v array<double>, cell int")


def _ids(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))


def _none(queries: DataFrame, query_id: str, row_id: str) -> DataFrame:
    return queries.select(F.col(query_id).cast("long").alias(query_id), F.lit(None).cast("long").alias(row_id), F.lit(None).cast("double").alias("d2"), F.lit(None).cast("int").alias("rank")).limit(0)


def _further(batch: pa.RecordBatch, boxes: Boxes, first: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """The work of `further_cells`: a query stands once for each cell, so few queries are one batch."""
    step = _step(boxes.pivots.size)
    for at in range(0, batch.num_rows, step):
        some = batch.slice(at, step)
        v, own, d2 = _matrix(some.column(1)), some.column(2).to_numpy(), some.column(3).to_numpy(zero_copy_only=False)
        may = boxes.gaps(v) <= (np.where(np.isnan(d2), np.inf, d2) * (1 + 1e-9) + 1e-300)[:, None]
        may &= boxes.count > 0
        for c in np.unique(own):
            may[np.ix_(own == c, first[c])] = False
        i, c = np.nonzero(may)
        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), some.column(1).take(pa.array(i)), pa.array(c.astype(np.int32))], names=["id", "v", "cell"])


def further_cells(queries: DataFrame, boxes: Boxes, first: list[list[int]], far: DataFrame) -> DataFrame:
    """(id, v, cell): the cells outside of `first` that may hold a row as near as a query's k-th so far.

    queries: (id, v, cell); far: (q, d2) with the squared distance of the k-th row found, if there are k.
    """
    asked = queries.join(far.withColumnRenamed("q", "id"), "id", "left")

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            yield from _further(batch, boxes, first)

    return asked.select("id", "v", "cell", "d2").mapInArrow(work, "id long, v array<double>, cell int")


def neighbours(
    queries: DataFrame, data: DataFrame, vector: str, k: int = 5, query_id: str = "seed_id", row_id: str = "row_id", exclude_self: bool = False,
    rows_per_block: int = 32_768, queries_per_block: int = 4096, rows_per_cell: int = 8192, most_cells: int = 4096,
) -> DataFrame:
    """I4: (query_id, row_id, d2, rank): exact k nearest by squared distance, ties to the smaller id.

    Rows lie in cells by their nearest pivot. A query first meets its own cell (and the nearest others, until they have
    k rows); the k-th distance found then rules out all cells whose boxes are farther away, and the query meets only those left.
    In a cell, rows and queries meet in blocks of bounded size. Pivots, boxes and numbers of the cells (at most
    `most_cells`) are all that the driver sees. Both: (id, vector as array<double>), ids distinct. Vectors that are
    null or hold nulls are an error.
    """
    cells = Cells(_ids(data, row_id, vector), rows_per_cell, most_cells)
    if not len(cells.boxes.pivots):
        return _none(queries, query_id, row_id)
    asked = scratch.kept(cells.placed(_ids(queries, query_id, vector)))
    first = cells.boxes.first(k + exclude_self)
    spark = data.sparkSession
    pairs = spark.createDataFrame([(i, c) for i, some in enumerate(first) for c in some], "own int, cell int")
    near = asked.withColumnRenamed("cell", "own").join(F.broadcast(pairs), "own").select("id", "v", "cell")
    meet = lambda q: _meet(q, cells.rows, ["cell"], k, exclude_self, rows_per_block, queries_per_block)
    found = scratch.kept(_ranked(meet(near), k))
    far = found.where(F.col("rank") == k).select("q", "d2")
    found = _ranked(found.drop("rank").unionByName(meet(further_cells(asked, cells.boxes, first, far))), k)
    return found.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "d2", "rank")


def approximate_neighbours(
    queries: DataFrame, data: DataFrame, vector: str, k: int = 5, query_id: str = "seed_id", row_id: str = "row_id", exclude_self: bool = False,
    tables: int = 12, directions: int = 3, width: float = 2.0, seed: int = 0, rows_per_block: int = 32_768, queries_per_block: int = 4096,
) -> DataFrame:
    """I4 by locality-sensitive hashing: the k nearest among the rows that share a bucket of any table with the query.

    A bucket is made of `directions` random directions, cut into steps of `width` (in the units of the vectors). Fewer
    than k rows come back where no more were met. More tables or wider steps find more and cost more.
    """
    dims = data.select(F.size(vector)).first()
    if dims is None:
        return _none(queries, query_id, row_id)
    rng = np.random.default_rng(seed)
    axes, starts = rng.normal(size=(tables, directions, dims[0])), rng.random((tables, directions))

    def bucketed(df: DataFrame) -> DataFrame:
        def work(batches):
            for batch in batches:
                v = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, axes.shape[2]))
                steps = np.floor(np.einsum("nd,tad->nta", v, axes) / width + starts).astype(np.int32)
                flat = pa.array([x.tobytes() for x in steps.reshape(len(v) * tables, directions)], pa.binary())
                row = pa.array(np.repeat(np.arange(len(v)), tables))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), flat], names=["id", "v", "t", "bucket"])

        return df.mapInArrow(work, "id long, v array<double>, t int, bucket binary")

    found = _meet(bucketed(_ids(queries, query_id, vector)), bucketed(_ids(data, row_id, vector)), ["t", "bucket"], k, exclude_self, rows_per_block, queries_per_block)
    return _ranked(found.distinct(), k).select(F.col("q").alias(query_id), F.col("r").alias(row_id), "d2", "rank")


def weighted(near: DataFrame, query_id: str = "seed_id") -> DataFrame:
    """Weights 1 / (d2 + epsilon), which sum to 1 for each query."""
    w = 1 / (F.col("d2") + EPSILON)
    return near.withColumn("w", w / F.sum(w).over(Window.partitionBy(query_id)))


def means(near: DataFrame, data: DataFrame, columns: Sequence[str], query_id: str = "seed_id", row_id: str = "row_id") -> DataFrame:
    """Weighted means of numeric columns."""
    rows = near.join(data.select(row_id, *columns), row_id)
    return rows.groupBy(query_id).agg(*(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in columns))


def votes(near: DataFrame, data: DataFrame, columns: Sequence[str], query_id: str = "seed_id", row_id: str = "row_id") -> DataFrame:
    """Of each categorical column the value with the most weight, ties to the first in order."""
    rows = near.join(data.select(row_id, *columns), row_id)
    long = rows.select(query_id, "w", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))).alias("column_name", "value"))
    sums = long.where("value is not null").groupBy(query_id, "column_name", "value").agg(F.sum("w").alias("w"))
    best = sums.groupBy(query_id, "column_name").agg(F.min_by("value", F.struct(-F.round("w", 12), F.col("value"))).alias("value"))
    return best.groupBy(query_id).pivot("column_name", list(columns)).agg(F.first("value"))


def synthesised(df: DataFrame, n: int, numeric: Sequence[str], categorical: Sequence[str], distance: Sequence[str], row_id: str = "listing_id", k: int = 5, seed: int = 2025) -> DataFrame:
    """N new rows from a table, with the numeric, then the categorical columns."""
    data = standardised(df.na.drop(subset=list(distance)), distance).withColumn("_x", F.array(*(F.col(f"z_{c}") for c in distance)))
    drawn = seeds(data, n, row_id, seed).join(data.select(row_id, "_x"), row_id).select("seed_id", "_x")
    near = weighted(neighbours(drawn, data, "_x", k, "seed_id", row_id))
    out = means(near, data, numeric, "seed_id", row_id)
    if categorical:
        out = out.join(votes(near, data, categorical, "seed_id", row_id), "seed_id")
    return out.select("seed_id", *numeric, *categorical)


def postprocessed(df: DataFrame, seed: int = 2025) -> DataFrame:
    """Rounded, then kept in range, then cast; of the columns that are there. Halves go up or down by a coin."""
    have = {c: F.col(c) for c in df.columns}
    whole = lambda c, s: numbers.random_round(F.col(c), seed + s).cast("int")
    out = {}
    if "price" in have:
        out["price"] = numbers.round_to("price", 10)
    for i, c in enumerate(("surface", "floor", "building_year")):
        if c in have:
            out[c] = whole(c, i)
    for i, (c, low, high) in enumerate((("total_room_number", 1, 6), ("bathrooms_number", 1, 4), ("energy_class", 1, 10))):
        if c in have:
            out[c] = numbers.clamp(whole(c, 3 + i), low, high)
    for c in ("condominium_monthly_expenses", "heating_yearly_expenses"):
        if c in have:
            out[c] = F.bround(F.col(c).cast("double"), 2)
    if "province" in have:
        out["province"] = F.replace(F.replace(F.col("province"), F.lit("l'aquila"), F.lit("aquila")), F.lit("monza-e-brianza"), F.lit("monza-brianza"))
    return df.withColumns(out)


def combined(parts: dict[str, DataFrame], id_column: str = "listing_id", shuffle_seed: int | None = None) -> DataFrame:
    """The types' rows in one table, the type behind the id; optionally in a seeded order."""
    frames = [df.select(id_column, F.lit(t).alias("listing_type"), *(c for c in df.columns if c != id_column)) for t, df in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if shuffle_seed is None else out.orderBy(F.rand(shuffle_seed))


#: Rows to synthesise when there are no counts.
DEFAULT_VOLUMES = {"rent": 80_000, "auction": 120_000, "sale": 850_000}


def volume_plan(counts: DataFrame | None, spark, step: int = 10_000) -> DataFrame:
    """Rows to synthesise by type: counts rounded to ten thousands, or the defaults."""
    if counts is None:
        return spark.createDataFrame(list(DEFAULT_VOLUMES.items()), "listing_type string, n bigint")
    return counts.select("listing_type", numbers.round_to("n", step).cast("bigint").alias("n"))
