"""Helpers shared by the operators: staged tables, Arrow batch limits, text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python.  Texts can be long, so the
#: byte limit is what bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Powers of two: bits that are broadcast at most (16 MB), and bits of one row of them (as ``bitmap_construct_agg`` has).
MARK_BITS, _BUCKET = 27, 15

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session has none (as in tests on one machine) is a
    temporary folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_tidemark_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.sparkContext._tidemark_dir = found
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in _staged.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(_sweep)


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged[path] = spark
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    An executor that is lost takes nothing with it: later stages read files.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path in _staged:
            _delete(_staged.pop(path), path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted, which Spark does when the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def marks(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Bits (``__bucket``, ``__bits``) at the hashes of some ``n`` keys, a table of one
    column, and the power of two of their number: sixteen bits a key, up to 2 ** MARK_BITS in all.

    Broadcast, they tell which rows of a wide table a join need not move.
    """
    power = min(max(_BUCKET, (16 * n).bit_length()), MARK_BITS)
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(1 << power))
    placed = keys.select(F.shiftright(at, _BUCKET).alias("__bucket"), at.bitwiseAND(F.lit((1 << _BUCKET) - 1)).alias("__bit")).repartition("__bucket")
    return placed.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")), power


def marked(table: DataFrame, key: str, found: tuple[DataFrame, int]) -> DataFrame:
    """The table and ``__marked``: false only where the key is none of those marked, true for
    all of them and a few others."""
    rows, power = found
    at = F.pmod(F.xxhash64(key), F.lit(1 << power))
    bit = at.bitwiseAND(F.lit((1 << _BUCKET) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1
    joined = table.withColumn("__bucket", F.shiftright(at, _BUCKET)).join(F.broadcast(rows), "__bucket", "left")
    return joined.withColumn("__marked", F.coalesce(is_set, F.lit(False))).drop("__bucket", "__bits")


def refuse_clash(carried, added) -> None:
    """Carried columns may not have the name of an added one, or begin with two underscores."""
    taken = {c.lower() for c in added}
    bad = [c for c in carried if c.lower() in taken or c.startswith("__") and c != "__doc"]
    if bad:
        raise ValueError(f"columns {', '.join(bad)} cannot be carried: {', '.join(added)} are added, and names with two underscores are taken")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, unless the session is stricter."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now or "") if c.isdigit())
        if not digits or int(digits) <= 0 or int(digits) > most:
            spark.conf.set(key, str(most))


def bounded_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the key columns: all where there are no more.

    The rows are counted first, and only those with small hashes (half more than
    asked for, on average) are ranked, so no task or driver ranks them all.
    """
    n = df.count()
    if n <= most:
        return df
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    return df.filter(place < int(1.5 * most / n * (1 << 40))).orderBy(place, *key).limit(most)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
