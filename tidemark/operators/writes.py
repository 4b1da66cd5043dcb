"""Writing: batches of puts and deletes get versions and join the changelog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def laid_out(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of the order, sorted in each, and checkpointed.

    A second job over a range partitioning may be dealt otherwise (its sample is
    drawn anew, and adaptive execution joins other partitions together), so what
    counts on partition numbers needs the rows to be laid down once.
    """
    shared_dir(rows.sparkSession)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def numbered(batch: DataFrame, *order: str) -> DataFrame:
    """The batch with ``ordinal`` 1, 2, ... in the given order.

    Rows are laid out in ranges once; each partition numbers its own rows, and the
    counts of the partitions before are added, so no task sees all rows.  Rows that
    are equal in the order get numbers in no set order.
    """
    laid = laid_out(batch, *order).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__at", 33).cast("int")
    counts = dict(laid.select(part.alias("part")).groupBy("part").count().collect())  # a row for each partition
    before, offsets = 0, []
    for k in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(before).cast("long"))
        before += counts.get(k, 0)
    if not offsets:
        return laid.select(*batch.columns, F.lit(None).cast("long").alias("ordinal"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.select(*batch.columns, (F.array(*offsets)[part] + place + 1).alias("ordinal"))


def put_rows(puts: DataFrame, base: int, *order: str) -> DataFrame:
    """Changelog rows of (key, value) with versions from ``base`` + 1."""
    rows = numbered(puts.select(*dict.fromkeys(("key", "value", *order))), *(order or ("key",)))
    return rows.select("key", (F.col("ordinal") + base).alias("version"), "value", F.lit(False).alias("deleted"))


def delete_rows(keys: DataFrame, base: int, *order: str) -> DataFrame:
    """Tombstones of (key) with versions from ``base`` + 1, whether or not the keys exist."""
    rows = numbered(keys.select(*dict.fromkeys(("key", *order))), *(order or ("key",)))
    none = F.lit(None).cast(keys.schema["key"].dataType).alias("value")
    return rows.select("key", (F.col("ordinal") + base).alias("version"), none, F.lit(True).alias("deleted"))


def put_batch(log: DataFrame, puts: DataFrame, base: int, *order: str) -> DataFrame:
    return log.select("key", "version", "value", "deleted").unionByName(put_rows(puts, base, *order))


def delete_batch(log: DataFrame, keys: DataFrame, base: int, *order: str) -> DataFrame:
    return log.select("key", "version", "value", "deleted").unionByName(delete_rows(keys, base, *order))


def txn_commit(log: DataFrame, puts: DataFrame, base: int) -> DataFrame:
    """All puts (key, value, seq) at one version, ``base`` + 1; of a key the last ``seq`` wins."""
    last = puts.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return log.select("key", "version", "value", "deleted").unionByName(last.select("key", F.lit(base + 1).cast("long").alias("version"), "value", F.lit(False).alias("deleted")))


def txn_remove_if(log: DataFrame, predicate: Column) -> DataFrame:
    """The log without rows that the predicate holds for (rows it is null for stay)."""
    return log.filter(~F.coalesce(predicate, F.lit(False)))
