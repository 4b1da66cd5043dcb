"""Compaction: dropping versions that no reader can see any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .writes import laid_out


def compact_latest(log: DataFrame, floor: int, tombstones: bool = False) -> DataFrame:
    """Rows above the floor and, per key, the newest row not above it unless that is a tombstone.

    Reads at the floor or later are as before.  ``tombstones`` keeps those too, as a
    part of a log must: an older row of the key may lie in another part.
    """
    order = Window.partitionBy("key").orderBy(F.col("version").desc())
    old = log.filter(F.col("version") <= floor).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return log.filter(F.col("version") > floor).unionByName(old if tombstones else old.filter("NOT deleted"))


def compact_adjacent(log: DataFrame) -> DataFrame:
    """Within a ``bucket``, in order of ``z``, runs of one ``key_hash`` become their newest row.

    The rows are laid out in ranges of z, whatever the number of buckets; each range
    collapses its own runs.  A run that goes on in the next range is at the ends of
    both: those rows, two a range at most, are stitched by the driver.  (A bucket is a
    range of z, so its rows lie together.)
    """
    laid = laid_out(log, "z", "version").withColumn("__part", F.spark_partition_id())
    order = Window.partitionBy("__part").orderBy("z", "version")
    same = F.lag("key_hash").over(order).eqNullSafe(F.col("key_hash")) & F.lag("bucket").over(order).eqNullSafe(F.col("bucket"))
    starts = F.when(same & (F.row_number().over(order) > 1), 0).otherwise(1)
    runs = laid.withColumn("__start", starts).withColumn("__run", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    newest = Window.partitionBy("__part", "__run").orderBy(F.col("version").desc(), F.col("z").desc())
    whole = Window.partitionBy("__part")
    kept = runs.withColumn("__last", F.max("__run").over(whole)).withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__start")
    ends = kept.filter((F.col("__run") == 1) | (F.col("__run") == F.col("__last")))
    gone = _superseded(sorted(tuple(r) for r in ends.select("__part", "__run", "bucket", "key_hash", "version").collect()))
    if gone:
        kept = kept.join(F.broadcast(log.sparkSession.createDataFrame(gone, "__part int, __run long")), ["__part", "__run"], "left_anti")
    return kept.select(*log.columns)


def _superseded(ends: list[tuple]) -> list[tuple[int, int]]:
    """Of the first and last runs of ranges in order (range, run, bucket, key hash,
    newest version): those that belong to one run with a newer row elsewhere."""
    gone, held = [], None
    for part, run, *own, version in ends:
        now = ((part, run), own, version)
        if run == 1 and held is not None and held[1] == own:
            older, now = sorted((held, now), key=lambda x: x[2])
            gone.append(older[0])
        held = now
    return gone


def segment_stats(log: DataFrame, *by: str) -> DataFrame:
    """Rows and the ranges of z and version, for each group."""
    return log.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.min("version").alias("v_min"), F.max("version").alias("v_max")
    )


def shard_load(log: DataFrame, capacity: int, share: float = 0.75) -> DataFrame:
    """(shard, rows, overloaded): shards over a share of their capacity want compaction."""
    return log.groupBy("shard").agg(F.count("*").alias("rows")).withColumn("overloaded", F.col("rows") > F.lit(int(capacity * share)))


def should_compact(log: DataFrame, capacity: int, share: float = 0.75) -> DataFrame:
    load = shard_load(log, capacity, share)
    over = F.count(F.when(F.col("overloaded"), 1))
    return load.agg(over.alias("overloaded_shards"), (over > 0).alias("compact"), F.when(over > F.lit(8), 1).otherwise(0).alias("priority"))
