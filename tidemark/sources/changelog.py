"""The changelog: rows of (key, version, value, deleted), and views of other tables as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("value", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


def schema_of(binary: bool = False) -> T.StructType:
    """The changelog's columns; keys and values are bytes if ``binary``."""
    return T.StructType([T.StructField(f.name, T.BinaryType()) if binary and f.name in ("key", "value") else f for f in SCHEMA])


#: Versions stay below this, so that Z values are non-negative.
VERSION_LIMIT = 2**31


def open_log(spark: SparkSession, binary: bool = False) -> DataFrame:
    """An empty changelog."""
    return spark.createDataFrame([], schema_of(binary))


def changelog(df: DataFrame, key: Column, version: Column, value: Column, deleted: Column) -> DataFrame:
    """Any table as a changelog; a tombstone has no value."""
    return df.select(
        key.cast("string").alias("key"),
        version.cast("long").alias("version"),
        F.when(~F.coalesce(deleted, F.lit(False)), value.cast("string")).alias("value"),
        F.coalesce(deleted, F.lit(False)).alias("deleted"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return changelog(df, F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("event_id") + 1, F.col("props"), F.col("event_type") == "error")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return changelog(df, F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")), F.col("o_orderkey") + 1, F.col("o_orderpriority"), F.col("o_orderstatus") == "F")
