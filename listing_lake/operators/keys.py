"""Deterministic, null-safe surrogate keys and dimension merges.

A key is the 64-bit hash of the JSON of a member's columns with NULLs written out, so (NULL, 'a') and ('a', NULL)
differ, two all-NULL members are one, and a key is the same in every run: facts compute it instead of joining.

Two members may have one hash. Where members meet, their natural keys are compared, and a member whose hash another one
has already gets a second hash (a third, ...). Such exceptions are a table of their own, mostly empty, by which facts
are put right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch


def natural(*columns: Column | str) -> Column:
    """A member's columns as one text: equal texts, equal members, NULL equal to NULL."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def key(*columns: Column | str, salt: int = 0, space: int | None = None) -> Column:
    """A member's hash; another one for each salt. space: keys from 0 to space - 1 instead of 64 bits."""
    out = F.xxhash64(natural(*columns), F.lit(salt)) if salt else F.xxhash64(natural(*columns))
    return out if space is None else F.pmod(out, F.lit(space))


def assigned(known: DataFrame, incoming: DataFrame, columns: Sequence[str], name: str, space: int | None = None, most_rounds: int = 64) -> DataFrame:
    """The members of `incoming` that `known` lacks, each with a key that no other member has.

    Members are told apart by their natural keys. A round gives each member without a key its next hash; of several with
    one hash that no other member has, the one with the smallest natural key takes it. Without a clash that is one
    round and a check. Rows of `incoming` with equal natural keys are one member (any of them).
    """
    have = known.select(natural(*columns).alias("_n"), F.col(name).alias("_k"))
    left = incoming.drop(name).withColumn("_n", natural(*columns)).dropDuplicates(["_n"]).join(have.select("_n"), "_n", "left_anti")
    done = None
    for salt in range(most_rounds):
        tried = left.withColumn("_k", key(*columns, salt=salt, space=space))
        taken = have.select("_k") if done is None else have.select("_k").unionByName(done.select("_k"))
        first = tried.join(taken, "_k", "left_anti").groupBy("_k").agg(F.min("_n").alias("_n"))
        placed = tried.join(first, ["_k", "_n"], "left_semi")
        done = placed if done is None else done.unionByName(placed)
        left = left.join(first.select("_n"), "_n", "left_anti")
        if salt:  # clashes are rare: only then are rounds written, so that plans stay short
            left, done = scratch.kept(left), scratch.kept(done)
        if not left.limit(1).count():
            return done.select(F.col("_k").alias(name), *(c for c in incoming.columns if c != name))
    raise RuntimeError(f"no free keys for {name} after {most_rounds} hashes")


def exceptions(members: DataFrame, columns: Sequence[str], name: str, space: int | None = None) -> DataFrame:
    """(natural, key) of the members whose key isn't their first hash."""
    return members.where(F.col(name) != key(*columns, space=space)).select(natural(*columns).alias("natural"), F.col(name).alias("key"))


def members(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Distinct members (NULL equals NULL) with their key."""
    return df.select(*columns).distinct().select(key(*columns).alias(name), *columns)


def single_value(df: DataFrame, value: Column, column: str, name: str) -> DataFrame:
    """Lower-cased values that aren't empty."""
    return members(df.select(F.lower(value).alias(column)).where(F.col(column) != ""), [column], name)


def merged(stored: DataFrame, incoming: DataFrame, name: str, fill: Sequence[str] = (), columns: Sequence[str] | None = None, space: int | None = None) -> DataFrame:
    """Stored members and the new ones; columns in `fill` that a stored member lacks are taken from incoming.

    columns: the natural key, by which members are told apart (all columns but the key and those in `fill`, if None).
    """
    columns = list(columns or (c for c in stored.columns if c != name and c not in fill))
    new = assigned(stored, incoming.select(*stored.columns), columns, name, space)
    if fill:
        more = incoming.select(natural(*columns).alias("_n"), *(F.col(c).alias(f"_{c}") for c in fill)).dropDuplicates(["_n"])
        kept = stored.join(more, natural(*columns) == F.col("_n"), "left")
        stored = kept.select(*(F.coalesce(c, f"_{c}").alias(c) if c in fill else F.col(c) for c in stored.columns))
    return stored.unionByName(new.select(*stored.columns))


def orphans(facts: DataFrame, dim: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Facts whose foreign key has no member; NULL is no violation."""
    return facts.where(F.col(fk).isNotNull()).join(dim.select(F.col(pk or fk).alias(fk)), fk, "left_anti")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural keys that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
