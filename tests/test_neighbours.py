"""Nearest neighbours by cells against brute force, how many cells they skip, and the recall of the hashed variant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.operators import synth


def frame(spark, v, name):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], f"{name} long, v array<double>")


def brute(q, v, k, exclude_self=False):
    out = {}
    for i, x in enumerate(q):
        d2 = ((x - v) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(v)), d2)) if not (exclude_self and j == i)][:k]
        out[i] = [(j, d2[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    v = np.concatenate([c + rng.normal(size=(150, 4)) for c in rng.uniform(-60, 60, (20, 4))])
    return np.concatenate([v, np.repeat(v[:1], 40, axis=0), np.round(v[:100])])  # a third of a cell alike, and ties


@pytest.mark.parametrize(("per_cell", "per_block", "exclude"), [(100, 64, False), (100, 64, True), (8192, 32_768, False), (2, 7, False)])
def test_neighbours_equal_brute_force(spark, clusters, per_cell, per_block, exclude):
    v = clusters if per_cell > 2 else clusters[::16]
    q = v if exclude else np.concatenate([v[::9], np.full((1, 4), 500.0)])
    got = {}
    out = synth.neighbours(frame(spark, q, "seed_id"), frame(spark, v, "row_id"), "v", 5, exclude_self=exclude, rows_per_block=per_block, queries_per_block=per_block, rows_per_cell=per_cell)
    for r in out.orderBy("seed_id", "rank").collect():
        got.setdefault(r.seed_id, []).append((r.row_id, r.d2))
    assert got == brute(q, v, 5, exclude)


def test_fewer_rows_than_neighbours(spark):
    v = np.array([[0.0], [2.0], [5.0]])
    out = synth.neighbours(frame(spark, v[:1], "seed_id"), frame(spark, v, "row_id"), "v", 5, rows_per_cell=1)
    assert [(r.row_id, r.d2) for r in out.orderBy("rank").collect()] == [(0, 0.0), (1, 4.0), (2, 25.0)]
    assert synth.neighbours(frame(spark, v, "seed_id"), frame(spark, v, "row_id").limit(0), "v").count() == 0
    assert synth.approximate_neighbours(frame(spark, v, "seed_id"), frame(spark, v, "row_id").limit(0), "v").count() == 0


def test_most_cells_are_skipped(spark, clusters):
    q, data = (frame(spark, clusters, n).withColumnRenamed(n, "id") for n in ("seed_id", "row_id"))
    cells = synth.Cells(data, 50, 4096)
    asked, first = cells.placed(q), cells.boxes.first(5)
    far = spark.createDataFrame([(i, float(x[-1][1])) for i, x in brute(clusters, clusters, 5).items()], "q long, d2 double")
    visits = synth.further_cells(asked, cells.boxes, first, far).count() + sum(len(first[r.cell]) for r in asked.select("cell").collect())
    share = 1 - visits / (len(clusters) * len(cells.boxes.pivots))
    print(f"share of query and cell pairs skipped: {share:.3f}")
    assert share > 0.8 and len(cells.boxes.pivots) > 50


def test_recall_of_the_hashed_variant(spark, clusters):
    q = clusters[::9]
    want = brute(q, clusters, 5)
    got = {}
    for r in synth.approximate_neighbours(frame(spark, q, "seed_id"), frame(spark, clusters, "row_id"), "v", 5, width=4.0, rows_per_block=512).collect():
        got.setdefault(r.seed_id, []).append(r.d2)
    recall = np.mean([sum(d2 <= want[i][-1][1] + 1e-9 for d2 in got.get(i, [])) / 5 for i in want])
    print(f"recall: {recall:.3f}")
    assert recall >= 0.9


def test_row_numbers_follow_the_order(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x")).repartition(7)
    assert all(r.x == r._n for r in synth.numbered(df, "x").collect())


def test_matrices_of_a_task_are_bounded():
    """However many queries, rows and cells meet, a task holds some matrices of a fixed size; results are those of brute force."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows, q = rng.normal(size=(32_768, 4)), rng.normal(size=(300, 4))
    tracemalloc.start()
    i, j, d2 = synth.nearest_rows(q, rows, np.arange(len(rows)), None, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    want = brute(q[:3], rows, 5)
    assert all(list(zip(j[i == k].tolist(), d2[i == k].tolist(), strict=True)) == want[k] for k in want)
    boxes = synth.Boxes(rows[:2000])
    boxes.low, boxes.high, boxes.count = rows[:2000], rows[:2000], np.ones(2000, np.int64)
    assert boxes.nearest(q).tolist() == [brute(q[k : k + 1], rows[:2000], 1)[0][0][0] for k in range(len(q))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(q.tolist()), pa.array([0] * 300, pa.int32()), pa.array([None] * 300, pa.float64())], names=["id", "v", "cell", "d2"])
    sizes = [b.num_rows for b in synth._further(batch, boxes, [[0]])]
    assert sum(sizes) == 300 * 1999 and max(sizes) * 4 <= synth.NUMBERS
