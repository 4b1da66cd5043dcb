"""Z layout of a log, and filters on it.

A point read at version V adds ``z BETWEEN z(h, 0) AND z(h, V)``: implied by key
and version, but min/max statistics of z-sorted files can prune with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zorder as Z

HASHES = {"le4": (Z.key_hash_le4, Z.py_le4), "fnv": (Z.key_hash_fnv_low, lambda key: Z.py_fnv(key) & Z.MASK)}


def with_z(log: DataFrame, kind: str = "le4", workers: int = Z.WORKERS) -> DataFrame:
    """The log with key_hash, z and bucket."""
    out = log.withColumn("key_hash", HASHES[kind][0](F.col("key")))
    out = out.withColumn("z", Z.z_encode(F.col("key_hash"), F.col("version")))
    return out.withColumn("bucket", Z.z_bucket(F.col("z"), workers))


def z_sort(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range partitioned by z and sorted in each partition: the layout of segment files."""
    laid = log.repartitionByRange(partitions, "z") if partitions else log.repartitionByRange("z")
    return laid.sortWithinPartitions("z")


def z_lookup(log: DataFrame, z: int) -> DataFrame:
    return log.filter(F.col("z") == z)


def z_range_scan(log: DataFrame, ranges: list[tuple[int, int]], version: int | None = None) -> DataFrame:
    """Rows in any of the closed Z ranges; all versions up to V, nothing removed."""
    hit = F.lit(False)
    for low, high in ranges:
        hit |= F.col("z").between(low, high)
    return log.filter(hit) if version is None else log.filter(hit & (F.col("version") <= version))


def key_interval(key: str, version: int, kind: str = "le4") -> tuple[int, int]:
    """The closed Z interval that holds all versions of a key up to V."""
    h = HASHES[kind][1](key)
    return Z.py_z(h, 0), Z.py_z(h, version)


def key_filter(key: str, version: int, kind: str = "le4") -> Column:
    low, high = key_interval(key, version, kind)
    return F.col("z").between(low, high) & (F.col("key_hash") == HASHES[kind][1](key))


def z_ranges(start: str, end: str, version: int, kind: str = "fnv") -> list[tuple[int, int]]:
    """The literal Z interval between two keys at a version; empty if their hashes are out of order."""
    low, high = (Z.py_z(HASHES[kind][1](k), version) for k in (start, end))
    return [(low, high)] if low <= high else []


def worker_ranges(workers: int = Z.WORKERS) -> list[tuple[int, int]]:
    """Equal closed ranges that cover all unsigned 64-bit values."""
    width = Z.bucket_width(workers)
    return [(k * width, (k + 1) * width - 1 if k < workers - 1 else 2**64 - 1) for k in range(workers)]


def split_box(hash_low: int, hash_high: int, v_low: int, v_high: int, most: int = 16) -> list[tuple[int, int]]:
    """At most ``most`` closed Z intervals that cover a box of hashes and versions.

    Quarters of the Z curve are cut until they lie in the box or the number of
    intervals is used up; adjacent ones are joined.
    """
    todo, done = [(0, 0, 32)], []
    while todo and len(todo) + len(done) < most:
        h, v, bits = todo.pop(0)
        size = 1 << bits
        if h > hash_high or h + size - 1 < hash_low or v > v_high or v + size - 1 < v_low:
            continue
        if bits == 0 or (hash_low <= h and h + size - 1 <= hash_high and v_low <= v and v + size - 1 <= v_high):
            done.append((h, v, bits))
            continue
        half = size >> 1
        todo += [(h + a * half, v + b * half, bits - 1) for b in (0, 1) for a in (0, 1)]
    touching = [q for q in todo if not (q[0] > hash_high or q[0] + (1 << q[2]) - 1 < hash_low or q[1] > v_high or q[1] + (1 << q[2]) - 1 < v_low)]
    spans = sorted((Z.py_z(h, v), Z.py_z(h + (1 << b) - 1, v + (1 << b) - 1)) for h, v, b in done + touching)
    out: list[list[int]] = []
    for low, high in spans:
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]
