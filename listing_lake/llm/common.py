"""Helpers shared by the operators of this subpackage: tables, checkpoints, Arrow texts, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    _LIBC = None
ROOT = Path(__file__).resolve().parents[2]
_SHARED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """This package's modules go to the workers with the job, once for each application.

    Texts are long: an Arrow batch's default of 10,000 rows becomes 1,000 in this session. Another value stays.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    sc = spark.sparkContext
    if sc.applicationId in _SHARED:
        return
    path = os.path.join(sc._temp_dir, "listing_lake_code.zip")  # the driver's own folder, from which Spark serves files
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted((ROOT / "listing_lake").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    sc.addPyFile(path)
    _SHARED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset: in local mode, as in tests, a temporary one, else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    share_code(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Shuffles that no table refers to any more leave the disk; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what goes first may hold others
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path that executors can open and map into memory.

    The shared folder must be mounted on every machine (a file: address or a plain path).
    """
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {place.geturl()}")
    path = os.path.join(unquote(place.path), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def give_back() -> None:
    """Freed memory goes back to the system: workers live on after a task, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        give_back()


def carried(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The table with its id (long) and text (string) again behind its own columns; the place of that id."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{id_col}`").cast("long").alias(free_name(docs, "id")), F.col(f"`{text_col}`").cast("string").alias(free_name(docs, "text"))), len(docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def appended(batch: pa.RecordBatch, n: int, /, **columns: pa.Array) -> pa.RecordBatch:
    """The first n columns of a batch with some more."""
    return pa.RecordBatch.from_arrays([*batch.columns[:n], *columns.values()], names=[*batch.schema.names[:n], *columns])


def widened(docs: DataFrame, /, **kinds: str):
    """The table's schema with some more columns."""
    from pyspark.sql import types as T

    out = T.StructType(list(docs.schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def fold(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo folds; a null id counts as the text ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_of(column: str, folds: int):
    """The same as a column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def tuned_groups(n_rows: int, per_group: int) -> int:
    return max(1, -(-n_rows // per_group))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star rounds.

    Returns (node, component): component is the smallest node reachable. A round keeps what is connected; the rounds
    end when the edges are stars, each node but the roots with one edge, to a root, which is checked on the edges
    themselves. If they aren't after `most_rounds`, an error is raised. Each round cuts its lineage in the shared
    folder; only a flag reaches the driver. Hub nodes are handled by a map-side minimum and a join, so no neighbour
    list is ever collected. An empty edge table has no components; edges with a null end and loops count for nothing.
    """
    kind = edges.schema[a].dataType
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(now.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    for _ in range(most_rounds):
        several = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        onward = now.join(now.select(F.col("v").alias("u")), "u", "left_semi").select("v")
        if not several.union(onward).limit(1).count():
            break
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(low.where("m < v").select("v", F.col("m").alias("u"))).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = cut(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
    else:
        raise RuntimeError(f"components aren't found after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    found = now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
    return found.select(F.col("node").cast(kind), F.col("component").cast(kind))
