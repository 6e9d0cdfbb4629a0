"""Folders that all executors see, below spark.checkpoint.dir, and tables that are derived once for each state of their source."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[tuple, str] = {}


def base_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(made := "file://" + tempfile.mkdtemp(prefix="scratch-"))
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name."""
    return posixpath.join(base_folder(spark), f"{name}-{uuid.uuid4().hex}")


def files_of(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, bytes, time of change) of every file below a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the tables at `source`, written the first time that an application asks for it.

    Later queries read what is there as long as the source's files are the same; else it is made again.
    """
    return spark.read.parquet(once_at(spark, name, source, lambda path: make().write.parquet(path)))


def once_at(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The folder of what `make` writes, made the first time that an application asks for it."""
    if not made(spark, name, source):
        make(path := folder(spark, name))
        _MADE[_key(spark, name, source)] = path
    return _MADE[_key(spark, name, source)]


def made(spark: SparkSession, name: str, source: str) -> bool:
    """Has this application written it from the source as it is now?"""
    key = _key(spark, name, source)
    return key in _MADE and exists(spark, _MADE[key])


def _key(spark: SparkSession, name: str, source: str) -> tuple:
    return spark.sparkContext.applicationId, name, files_of(spark, source)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this module's."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written and read: a plan that starts anew."""
    df.write.parquet(path := folder(df.sparkSession, "kept"))
    return df.sparkSession.read.schema(df.schema).parquet(path)
