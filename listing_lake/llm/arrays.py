"""Sorted hash arrays in a mounted shared folder: written by tasks, mapped into memory by others.

A store has shards; a shard is a sorted array of unsigned 64-bit keys and one array of values for each field. Files
are written under another name and renamed, so a task that runs again after a lost executor leaves the same files.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa

MIX = np.uint64(0x9E3779B97F4A7C15)
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,)) if len(data) >= 8 else np.zeros(0, "<u8")


def stirred(h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Hashes that have taken in the k-th eight bytes: one-to-one in these as well as in the hash before."""
    h = (h ^ w) * _K[k % 3]
    h ^= h >> np.uint64(29 + k % 5)
    return h


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its scrambled upper half."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def write(folder: str, name: str, shard: int, keys: np.ndarray, **fields: np.ndarray) -> None:
    for field, values in ({"keys": keys} | fields).items():
        path = os.path.join(folder, f"{name}-{shard}-{field}.npy")
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, path)


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    if not os.path.exists(path):
        return None
    return np.load(path, mmap_mode="r")


def read(folder: str, name: str, shard: int, field: str) -> np.ndarray | None:
    return _mapped(os.path.join(folder, f"{name}-{shard}-{field}.npy"))


def look_up(folder: str, name: str, shards: np.ndarray, keys: np.ndarray, **fields) -> dict[str, np.ndarray]:
    """For each key its values, or each field's given default; "hit" tells which keys are there.

    Keys are looked up sorted by shard and value, so that a batch touches each page of a mapped file once.
    """
    out = {f: np.full(len(keys), default) for f, default in fields.items()}
    out["hit"] = np.zeros(len(keys), bool)
    order = np.lexsort((keys, shards))
    s = shards[order]
    starts = heads(s)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)][: len(starts)], strict=True):
        there = read(folder, name, int(s[a]), "keys")
        if there is None or not len(there):
            continue
        rows = order[a:b]
        k = keys[rows]
        at = np.minimum(np.searchsorted(there, k), len(there) - 1)
        hit = there[at] == k
        rows, at = rows[hit], at[hit]
        out["hit"][rows] = True
        for f in fields:
            out[f][rows] = read(folder, name, int(s[a]), f)[at]
    return out


def stored(df, folder: str, name: str, per_shard: int = 1 << 20) -> tuple[str, str, int]:
    """A table of whole numbers, none NULL, whose first column is a key that no two rows share, as a store that `held` reads.

    Tasks write it and map it: it may have any number of rows, none goes through the driver, and what is looked up in it is
    not moved.
    """
    key, *fields = df.columns
    shards = max(1, -(-df.count() // per_shard))

    def dealt(batches):
        for batch in batches:
            own = shard_of(batch.column(0).to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], names=["shard", *batch.schema.names])

    def written(rows: pa.Table) -> pa.Table:
        keys = rows.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        write(folder, name, rows.column("shard")[0].as_py(), keys[order], **{f: rows.column(f).to_numpy()[order] for f in fields})
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    kinds = ", ".join(f"{c} long" for c in df.columns)
    df.mapInArrow(dealt, f"shard long, {kinds}").groupBy("shard").applyInArrow(written, "n long").agg({"n": "sum"}).collect()
    return folder, name, shards


def held(store: tuple[str, str, int], keys: pa.Array, **fields) -> dict[str, np.ndarray]:
    """What a store has of a column of keys without NULLs; see look_up."""
    folder, name, shards = store
    k = keys.to_numpy().view(np.uint64)
    return look_up(folder, name, shard_of(k, shards), k, **fields)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin to differ from the row before; the first row, if there is one, does."""
    n = len(columns[0])
    fresh = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        fresh |= c[1:] != c[:-1]
    return np.nonzero(np.append(True, fresh))[0] if n else np.zeros(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = heads(keys)
    return keys[starts], np.add.reduceat(counts.astype(np.int64), starts)


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest unsigned type that holds them; as they are, if some are negative."""
    most = int(x.max()) if len(x) else 0
    if len(x) and x.min() < 0:
        return x
    return x.astype(next(t for t in ("u1", "u2", "u4", "u8") if most < 1 << 8 * int(t[1])))
