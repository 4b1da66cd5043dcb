"""Reading a changelog: as of a version, by key, by range, over time.

The row that counts for a key at version V is the one of the largest version
not above V; if it is a tombstone the key is absent.  Version 0 is never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(log: DataFrame, version: int | None = None) -> DataFrame:
    out = log.filter(F.col("version") > 0)
    return out if version is None else out.filter(F.col("version") <= version)


def newest_rows(log: DataFrame, version: int | None = None) -> DataFrame:
    """The newest row of each key, tombstones included."""
    order = Window.partitionBy("key").orderBy(F.col("version").desc())
    return visible(log, version).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def latest_per_key(log: DataFrame, version: int | None = None) -> DataFrame:
    return newest_rows(log, version).filter(~F.col("deleted"))


def snapshot(log: DataFrame, version: int | None = None) -> DataFrame:
    """(key, value) of all live keys."""
    return latest_per_key(log, version).select("key", "value")


def get_as_of(log: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """(key, version, value) of one key, or no row: a top-1 over pushed filters, no shuffle of the log."""
    newest = visible(log, version).filter(F.col("key") == key).orderBy(F.col("version").desc()).limit(1)
    return newest.filter(~F.col("deleted")).select("key", "version", "value")


def get_latest(log: DataFrame, key: str) -> DataFrame:
    return get_as_of(log, key)


def get_by_hash(log: DataFrame, key: str, key_hash: int, version: int | None = None) -> DataFrame:
    """As ``get_as_of`` on a log with ``key_hash``: the hash prunes, the key decides."""
    return get_as_of(log.filter(F.col("key_hash") == key_hash), key, version)


def multi_get(log: DataFrame, keys: DataFrame, version: int | None = None) -> DataFrame:
    """(key, version, value) of the requested keys that are live.

    The requested keys are made distinct by a shuffle, whose measured bytes let
    adaptive execution broadcast them or not; there is no job before the join.
    """
    hit = visible(log, version).join(keys.select("key").distinct(), "key", "left_semi")
    return latest_per_key(hit).select("key", "version", "value")


def in_range(start: str | None = None, end: str | None = None) -> Column:
    """Start included, end excluded; None is open.  Strings compare by their bytes."""
    out = F.lit(True)
    if start is not None:
        out &= F.col("key") >= start
    if end is not None:
        out &= F.col("key") < end
    return out


def scan_as_of(log: DataFrame, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
    return snapshot(log.filter(in_range(start, end)), version)


def prefix_scan(log: DataFrame, prefix: str, version: int | None = None) -> DataFrame:
    return snapshot(log.filter(F.startswith(F.col("key"), F.lit(prefix))), version)


def history(log: DataFrame, key: str, start: int | None = None, end: int | None = None, tombstones: bool = False) -> DataFrame:
    """(version, value) of one key in ascending order, both ends included.

    A tombstone shows as an empty value; ``tombstones`` adds the column ``deleted``.
    """
    rows = visible(log, end).filter(F.col("key") == key)
    if start is not None:
        rows = rows.filter(F.col("version") >= start)
    nothing = F.lit("").cast(log.schema["value"].dataType)
    value = F.when(F.col("deleted"), nothing).otherwise(F.col("value")).alias("value")
    return rows.select("version", value, *(["deleted"] if tombstones else [])).orderBy("version")


def entry_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"))


def latest_version(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("latest"))


def next_version(log: DataFrame) -> DataFrame:
    return latest_version(log).select((F.col("latest") + 1).alias("next_version"))


def scan_count(log: DataFrame, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
    return scan_as_of(log, start, end, version).agg(F.count("*").alias("rows"))


def history_count(log: DataFrame, key: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return history(log, key, start, end).agg(F.count("*").alias("rows"))


def stats(log: DataFrame) -> DataFrame:
    """One row: entries, tombstones, keys, least and latest version."""
    return log.agg(
        F.count("*").alias("entries"),
        F.count(F.when(F.col("deleted"), 1)).alias("tombstones"),
        F.countDistinct("key").alias("keys"),
        F.min("version").alias("first_version"),
        F.max("version").alias("latest_version"),
    )


def version_uniqueness(log: DataFrame) -> DataFrame:
    """Versions that occur more than once."""
    return log.groupBy("version").agg(F.count("*").alias("n")).filter("n > 1")


def version_order_violations(log: DataFrame) -> DataFrame:
    """Per key, rows whose version does not exceed the one before in arrival order (``arrival``)."""
    order = Window.partitionBy("key").orderBy("arrival")
    return log.withColumn("before", F.lag("version").over(order)).filter("version <= before").select("key", "version", "before")


def value_counts(log: DataFrame, version: int | None = None) -> DataFrame:
    return snapshot(log, version).groupBy("value").agg(F.count("*").alias("n"))


# Beyond the verbs -----------------------------------------------------------


def as_of_join(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probes (probe_id, key, at) with the version and value that were live then.

    One pass: probes and rows of a key are laid in order of version, and each
    probe takes the last row before it, so no pair of probe and row is built.
    """
    rows = visible(log).select("key", F.col("version").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe_id"), F.struct("version", "value", "deleted").alias("row"))
    asked = probes.select("key", "at", F.lit(1).alias("kind"), "probe_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(asked).withColumn("row", F.last("row", ignorenulls=True).over(order)).filter("kind = 1")
    live = F.col("row").isNotNull() & ~F.col("row.deleted")
    return met.select("probe_id", "key", "at", F.when(live, F.col("row.version")).alias("version"), F.when(live, F.col("row.value")).alias("value"))


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """(key, change, old_value, new_value) between two versions, in one pass over the log."""
    at = lambda v: F.max_by(F.struct("value", "deleted"), F.when(F.col("version") <= v, F.col("version")))
    rows = visible(log, new).groupBy("key").agg(F.when(F.min("version") <= old, at(old)).alias("o"), at(new).alias("n"))
    was, is_ = F.coalesce(~F.col("o.deleted"), F.lit(False)), F.coalesce(~F.col("n.deleted"), F.lit(False))
    change = F.when(~was & is_, "added").when(was & ~is_, "removed").when(was & is_ & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    out = rows.select("key", change.alias("change"), F.when(was, F.col("o.value")).alias("old_value"), F.when(is_, F.col("n.value")).alias("new_value"))
    return out.filter("change IS NOT NULL")


def change_feed(log: DataFrame, after: int, until: int) -> DataFrame:
    """All rows of versions in (after, until]."""
    return log.filter((F.col("version") > after) & (F.col("version") <= until)).select("key", "version", "value", "deleted")
