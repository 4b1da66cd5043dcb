"""Tiers: recent rows are hot, compacted ones cold; reads see their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reads

TIERS = ("hot", "warm", "cold")


def assign_tier(log: DataFrame, hot_from: int, warm_from: int | None = None) -> DataFrame:
    """Tier by age of version."""
    warm = F.lit(hot_from if warm_from is None else warm_from)
    return log.withColumn("tier", F.when(F.col("version") >= hot_from, "hot").when(F.col("version") >= warm, "warm").otherwise("cold"))


def union(*tiers: DataFrame) -> DataFrame:
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier)
    return out


def tier_get(tiers: list[DataFrame], key: str, version: int | None = None) -> DataFrame:
    """The row of the largest version not above V in any tier, so no tier hides another's newer row."""
    return reads.get_as_of(union(*tiers), key, version)


def tier_scan(tiers: list[DataFrame], start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
    return reads.scan_as_of(union(*tiers), start, end, version)


def tier_stats(log: DataFrame) -> DataFrame:
    """One row: entries in all and by tier."""
    return log.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in TIERS])
