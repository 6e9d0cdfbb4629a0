"""Exact top-k inner products by MaxScore.

Vector components are the terms and their whole numbers the weights. A shard of rows is an index of chunks: rows that
lie close together share a chunk (halved again and again along the line between two rows far apart), which keeps for each term its
postings (a column, in the chunk's row order) and the lowest and highest weight. So a query's term contributes
between two bounds in a chunk, and a chunk whose upper bounds add up to less than the query's k-th best score is left
out as a whole. Contributions are counted from the lower bound, which makes them all positive. Of the terms by falling
span, the last ones are non-essential if their spans can't lift a row from the lowest score to the threshold; the
others are essential. Essential postings are traversed first, for all competitive queries of a block at once (one
product over these columns only). While most rows stay competitive, further terms are traversed in the same way;
then only the rows whose score plus the upper bounds left reaches the threshold are probed, largest span first.
Shards are merged by score.

Scale: rows lie in shards and queries in blocks of bounded size, each packed into one row of bytes before they meet; a
task joins one shard with one block. Each query leaves k rows for each shard. Nothing is broadcast, and the driver
gets four numbers.
Rows: vectors that are null, of other length than most, or hold null or non-finite components take no part; rows
with a null id neither; rows with equal ids are a candidate each, but none for a query of that id; an empty table has
no results. Other columns, whatever their names, are not looked at. Scores beyond a long wrap around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ROWS, QUERIES, CHUNK, STEP = 32_768, 2048, 512, 8
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): components times scale, rounded down, of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where((F.size(vector_col) > 0) & fine)
    return known.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


class Shard:
    """Rows in chunks, with the bounds of each term in each chunk."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.rows, self.ids, self.starts, self.stops = rows, ids, np.append(0, ends[:-1]), ends
        self.low, self.high = (f.reduceat(rows, self.starts, axis=0) for f in (np.minimum, np.maximum))


def chunks_of(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): chunks of at most `most` rows, by halving along the line between two rows far apart."""
    rows = rows.astype(np.float64)
    open_, done = [np.arange(len(rows))], []
    while open_:
        part = open_.pop()
        if len(part) <= most:
            done.append(part)
            continue
        x, half = rows[part], len(part) // 2
        one = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
        other = x[np.argmax(((x - one) ** 2).sum(axis=1))]
        cut = np.argpartition(x @ (one - other), half)
        open_ += [part[cut[half:]], part[cut[:half]]]
    return np.concatenate(done), np.cumsum([len(x) for x in done])


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.threshold, self.last_id, self.known = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, score = np.append(self.query, query), np.append(self.id, ids), np.append(self.score, score)
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, np.arange(self.n))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.id, self.score = query[keep], ids[keep], score[keep]
        last = np.searchsorted(self.query, np.arange(self.n), "right")
        self.known = last - np.searchsorted(self.query, np.arange(self.n)) == self.k
        at = last[self.known] - 1
        self.threshold[self.known], self.last_id[self.known] = self.score[at], self.id[at]


def _where(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(hits), hits.shape[1])


def maxscore(shard: Shard, queries: np.ndarray, own: np.ndarray, k: int, work: dict | None = None) -> Best:
    """The k best rows of one shard for each query of a block, exact.

    work, if given, counts the products that were added ("done") and those of comparing all with all ("all").
    """
    n, dims = queries.shape
    best = Best(n, k)
    if not len(shard.rows):
        return best
    most = max(int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (shard.rows, queries))
    # sums of whole numbers are exact in floating point below its precision; beyond it they wrap, without bounds
    kind = np.float32 if dims * most * most < 1 << 24 else np.float64 if dims * most * most < 1 << 53 else np.int64
    bounded = kind != np.int64
    q = queries.astype(kind)
    if bounded:
        low, high = shard.low.astype(kind), shard.high.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        upper, lower = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    every = np.arange(n)
    first = upper.argmax(axis=1) if bounded else np.full(n, -1)  # a query sees its most promising chunk first
    visits = [(c, every[first == c]) for c in np.unique(first[first >= 0]).tolist()]
    visits += [(c, every[first != c]) for c in (np.argsort(-upper.sum(axis=0), kind="stable") if bounded else np.arange(len(shard.starts))).tolist()]
    for c, active in visits:
        part, ids = shard.rows[shard.starts[c] : shard.stops[c]].astype(kind), shard.ids[shard.starts[c] : shard.stops[c]]
        threshold = np.where(best.known, best.threshold, np.iinfo(np.int64).min)
        asked = len(active)
        if bounded:
            active = active[~best.known[active] | (upper[active, c] >= threshold[active])]
        if work is not None:
            work["all"] = work.get("all", 0) + len(part) * asked * dims
        if not len(active):
            continue
        x, all_known = q[active], bounded and bool(best.known[active].all())
        order, essential = np.arange(dims), dims
        if all_known:
            wanted = threshold[active].astype(kind)
            span = np.abs(x) * (high[c] - low[c])
            order = np.argsort(-span.sum(axis=0), kind="stable")
            groups = np.arange(0, dims, STEP)  # terms are taken in groups
            after = lambda terms: np.append(np.add.reduceat(terms[:, order], groups, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(x), 1), kind), axis=1)
            rising = lower[active, c][:, None] + after(span) >= wanted[:, None] - 1e-3
            essential = min(dims, int(rising.sum(axis=1).max()) * STEP)
            rest = after(np.maximum(x, 0) * high[c] + np.minimum(x, 0) * low[c])  # upper bounds from a group on
        part, x = np.ascontiguousarray(part[:, order]), np.ascontiguousarray(x[:, order])
        scores = x[:, :essential] @ part[:, :essential].T
        while essential < dims:  # more terms for all rows, while many of a few rows stay competitive
            some = scores[:, :: max(len(part) // 16, 1)]
            if np.count_nonzero(some >= (wanted - rest[:, -(-essential // STEP)])[:, None]) * 32 < some.size:
                break
            to = min(essential + 2 * STEP, dims)
            scores += x[:, essential:to] @ part[:, essential:to].T
            essential = to
        done = essential * scores.size
        if all_known:
            at, r = _where(scores >= (wanted - rest[:, -(-essential // STEP)])[:, None])
        else:
            mine = np.nonzero(np.isin(own[active], ids))[0]
            whole = scores.copy() if len(mine) else scores
            lowest = np.iinfo(np.int64).min if kind == np.int64 else -np.inf
            whole[mine] = np.where(ids[None, :] == own[active[mine]][:, None], lowest, whole[mine])
            if len(ids) > k:
                at, r = _where(whole >= np.partition(whole, len(ids) - k, axis=1)[:, len(ids) - k][:, None])
            else:
                at, r = _where(np.ones(scores.shape, bool))
        s = scores[at, r]
        while essential < dims and len(at):
            to = min(essential + STEP, dims)
            s = s + np.einsum("nd,nd->n", x[at, essential:to], part[r, essential:to])
            done += len(at) * (to - essential)
            keep = s >= wanted[at] - rest[at, -(-to // STEP)]
            at, r, s, essential = at[keep], r[keep], s[keep], to
        if work is not None:
            work["done"] = work.get("done", 0) + done
        query, found, s = active[at], ids[r], s.astype(np.int64)
        keep = found != own[query]
        keep &= ~best.known[query] | (s > best.threshold[query]) | (s == best.threshold[query]) & (found < best.last_id[query])
        best.add(query[keep], found[keep], s[keep])
    return best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of one length as a matrix."""
    parts = [np.asarray(x.flatten()).reshape(-1, width) for x in column.chunks]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)


def packed(vectors: DataFrame, parts: int, width: int, kind: str, chunk: int) -> DataFrame:
    """One row for each part: its ids, its matrix and the ends of its chunks, as bytes. vectors: (part, id, v)."""

    def pack(rows: pa.Table) -> pa.Table:
        x, ids = _matrix(rows.column("v"), width), rows.column("id").to_numpy()
        order, ends = chunks_of(x, chunk)
        blobs = {"ids": ids[order].astype("<i8"), "rows": x[order].astype(kind), "ends": ends.astype("<i8")}
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int64()), **{f: pa.array([b.tobytes()], pa.binary()) for f, b in blobs.items()}})

    return vectors.repartition(parts, "part").groupBy("part").applyInArrow(pack, "part long, ids binary, rows binary, ends binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows_per_shard: int = ROWS, queries_per_block: int = QUERIES, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products with rows of another id. Both: (id, v)."""
    common.share_code(vectors.sparkSession)
    sizes = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    top = sizes.orderBy(F.desc("n"), "width").limit(1).first()
    width, n_rows, most = (top["width"], top["n"], top["most"]) if top else (0, 0, 0)
    asked = queries.where(F.size("v") == width)
    n_asked = asked.count()
    shards, blocks = common.tuned_groups(n_rows, rows_per_shard), common.tuned_groups(n_asked, queries_per_block)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    # the row's number is in the hash, so that many rows of one id are spread as well
    part = lambda n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).alias("part")
    index = packed(vectors.where(F.size("v") == width).select(part(shards), "id", "v"), shards, width, kind, chunk)
    block = packed(asked.select(part(blocks), "id", "v"), blocks, width, "<i8", max(n_asked, 1))
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", F.col("part") * blocks + F.col("other"))
    block = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("cell", F.col("other") * blocks + F.col("part"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        read = lambda t, f, d: np.frombuffer(t.column(f)[0].as_buffer(), d)
        shard = Shard(read(left, "rows", kind).reshape(-1, width), read(left, "ids", "<i8"), read(left, "ends", "<i8"))
        own = read(right, "ids", "<i8")
        best = maxscore(shard, read(right, "rows", "<i8").reshape(-1, width), own, k)
        return pa.Table.from_arrays([pa.array(own[best.query]), pa.array(best.id), pa.array(best.score)], schema=FOUND)

    found = index.groupBy("cell").cogroup(block.groupBy("cell")).applyInArrow(work, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(common.table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % 50 == 0)).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS score
  FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
