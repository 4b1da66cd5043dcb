"""The registered queries of the versioned key-value engine, each beside its SQL.

The changelog is a view of ``events``: user ids are keys, event ids versions,
and errors tombstones.  A few queries run on the like view of ``orders``.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import zorder as Z
from .operators import compaction, reads, tiers, writes
from .plans import zfilters
from .sources.changelog import SCHEMA, events_log, orders_log
from .sources.scratch import shared_dir
from .sources.store import LateRows, Store, StoreConfig, VersionNotFound, _Files
from .streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
V, KEY, START, END, FLOOR = 5000, "user:104", "user:1", "user:3", 6000

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Logs, and the spread and hash steps, as common table expressions.
LOG = """WITH log AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS key, event_id + 1 AS version,
  CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS deleted FROM events),
orders_log AS (SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, o_orderkey + 1 AS version,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS value, o_orderstatus = 'F' AS deleted FROM orders)"""
NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS rn FROM {rows}) WHERE rn = 1 AND NOT deleted)"
_STEPS = [(16, 281470681808895), (8, 71777214294589695), (4, 1085102592571150095), (2, 3689348814741910323), (1, 6148914691236517205)]


def _spread_cte(source: str, column: str, out: str) -> str:
    body = f"SELECT *, CAST({column} AS BIGINT) AS {out} FROM {source}"
    for shift, mask in _STEPS:
        body = f"SELECT * REPLACE (({out} | ({out} << {shift})) & {mask} AS {out}) FROM ({body})"
    return body


#: The log with both hashes, and its z by either.
HASHED = (
    LOG
    + """, le4 AS (SELECT *, CAST(ascii(substr(key, 1, 1)) + (ascii(substr(key, 2, 1)) << 8) + (ascii(substr(key, 3, 1)) << 16)
  + (CAST(ascii(substr(key, 4, 1)) AS BIGINT) << 24) AS BIGINT) AS key_hash FROM log),
fnv AS (SELECT *, CAST(list_reduce(list_prepend(CAST(2216829733 AS BIGINT), list_transform(range(1, length(key) + 1),
  lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 435) & 4294967295) AS BIGINT) AS key_hash FROM log),
zl AS (SELECT * EXCLUDE (hs, vs), hs | (vs << 1) AS z, LEAST((hs | (vs << 1)) // 4611686018427387903, 3) AS bucket FROM ("""
    + _spread_cte("(" + _spread_cte("le4", "key_hash", "hs") + ")", "version", "vs")
    + ")), zf AS (SELECT * EXCLUDE (hs, vs), hs | (vs << 1) AS z, LEAST((hs | (vs << 1)) // 4611686018427387903, 3) AS bucket FROM ("
    + _spread_cte("(" + _spread_cte("fnv", "key_hash", "hs") + ")", "version", "vs")
    + "))"
)


def _query(sql: str | None = None, base: str = LOG):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"{base}\n{sql}"
        return f

    return add


def newest(version: int | None = None, where: str = "TRUE", log: str = "log") -> str:
    bound = f"version <= {version} AND" if version is not None else ""
    return NEWEST.format(rows=f"{log} WHERE {bound} {where}")


# Verbs


@_query(f"SELECT key, value FROM {newest(500)}")
def snapshot(s, d):
    return reads.snapshot(events_log(s, d), 500)


@_query(f"SELECT key, value FROM {newest(V)}")
def snapshot_as_of(s, d):
    return reads.snapshot(events_log(s, d), V)


@_query(f"SELECT key, value FROM {newest()}")
def snapshot_latest(s, d):
    return reads.snapshot(events_log(s, d))


@_query(f"SELECT key, value FROM {newest(7000, log='orders_log')}")
def snapshot_orders(s, d):
    return reads.snapshot(orders_log(s, d), 7000)


@_query(f"SELECT key, version, value, deleted FROM {newest(V)}")
def latest_per_key(s, d):
    return reads.latest_per_key(events_log(s, d), V)


@_query(f"SELECT key, version, value FROM {newest(V, f'''key = '{KEY}' ''')}")
def get_as_of(s, d):
    return reads.get_as_of(events_log(s, d), KEY, V)


@_query(f"SELECT key, version, value FROM {newest(None, f'''key = '{KEY}' ''')}")
def get_latest(s, d):
    return reads.get_latest(events_log(s, d), KEY)


_DELETED = "(SELECT key, version AS since FROM log l WHERE deleted AND EXISTS (SELECT 1 FROM log b WHERE b.key = l.key AND b.version < l.version) ORDER BY since LIMIT 1)"


@_query(
    f"""SELECT p.at, n.version, n.value FROM (SELECT 'before' AS at, 1 AS back UNION ALL SELECT 'deleted', 0) p
LEFT JOIN (SELECT x.since - b.back AS "until", b.back, l.version, l.value, l.deleted, row_number() OVER (PARTITION BY b.back ORDER BY l.version DESC) AS rn
  FROM {_DELETED} x, (SELECT 1 AS back UNION ALL SELECT 0) b, log l WHERE l.key = x.key AND l.version <= x.since - b.back) n ON n.back = p.back AND n.rn = 1 AND NOT n.deleted"""
)
def get_deleted_as_of(s, d):
    """A key just before it is deleted, and at the version of its tombstone, where it is absent."""
    log = events_log(s, d)
    order = Window.partitionBy("key").orderBy("version")
    first = log.withColumn("n", F.row_number().over(order)).filter("deleted AND n > 1").orderBy("version").select("key", "version").first()
    wanted = s.createDataFrame([("before",), ("deleted",)], "at string")
    if first is None:
        return wanted.select("at", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("value"))
    found = [reads.get_as_of(log, first["key"], first["version"] - back).select(F.lit(at).alias("at"), "version", "value") for at, back in (("before", 1), ("deleted", 0))]
    return wanted.join(found[0].unionByName(found[1]), "at", "left")


@_query(f"SELECT key, version, value FROM {NEWEST.format(rows=f'zl WHERE version <= {V} AND key = ' + chr(39) + KEY + chr(39))}", HASHED)
def get_by_hash(s, d):
    return reads.get_by_hash(zfilters.with_z(events_log(s, d)), KEY, Z.py_le4(KEY), V)


_ASKED = "key IN (SELECT 'user:' || CAST(c_custkey AS VARCHAR) FROM customer)"


@_query(f"SELECT key, version, value FROM {newest(V, _ASKED)}")
def multi_get(s, d):
    """The live rows of all customers' keys."""
    keys = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return reads.multi_get(events_log(s, d), keys, V)


def _scan(start: str | None, end: str | None) -> str:
    where = [f"key >= '{start}'"] if start else []
    where += [f"key < '{end}'"] if end else []
    return f"SELECT key, value FROM {newest(V, ' AND '.join(where))}"


@_query(_scan(START, END))
def scan_as_of(s, d):
    return reads.scan_as_of(events_log(s, d), START, END, V)


@_query(_scan(None, END))
def scan_open_start(s, d):
    return reads.scan_as_of(events_log(s, d), None, END, V)


@_query(_scan(START, None))
def scan_open_end(s, d):
    return reads.scan_as_of(events_log(s, d), START, None, V)


@_query(f"SELECT key, value FROM {newest(V, '''key LIKE 'user:1%' ''')}")
def prefix_scan(s, d):
    return reads.prefix_scan(events_log(s, d), "user:1", V)


_HISTORY = f"SELECT version, CASE WHEN deleted THEN '' ELSE value END AS value FROM log WHERE key = '{KEY}'"


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their places, so that the order can be compared too.  It is a check of small results only."""
    columns, rows = df.schema, df.collect()
    return df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], T.StructType([T.StructField("place", T.LongType()), *columns.fields]))


_PLACED = "SELECT row_number() OVER (ORDER BY version) - 1 AS place, * FROM ({})"


@_query(_PLACED.format(_HISTORY))
def history(s, d):
    return _ordered(reads.history(events_log(s, d), KEY))


@_query(_PLACED.format(f"{_HISTORY} AND version BETWEEN 100 AND {V}"))
def history_range(s, d):
    return _ordered(reads.history(events_log(s, d), KEY, 100, V))


@_query(_PLACED.format(_HISTORY.replace("AS value FROM", "AS value, deleted FROM")))
def history_with_tombstones(s, d):
    return _ordered(reads.history(events_log(s, d), KEY, tombstones=True))


@_query("SELECT count(*) AS entries FROM log")
def entry_count(s, d):
    return reads.entry_count(events_log(s, d))


@_query("SELECT max(version) AS latest FROM log")
def latest_version(s, d):
    return reads.latest_version(events_log(s, d))


@_query("SELECT max(version) + 1 AS next_version FROM log")
def next_version(s, d):
    return reads.next_version(events_log(s, d))


@_query(f"SELECT count(*) AS rows FROM ({_scan(START, END)})")
def scan_count(s, d):
    return reads.scan_count(events_log(s, d), START, END, V)


@_query(f"SELECT count(*) AS rows FROM ({_HISTORY})")
def history_count(s, d):
    return reads.history_count(events_log(s, d), KEY)


@_query("SELECT count(*) AS entries, count(*) FILTER (deleted) AS tombstones, count(DISTINCT key) AS keys, min(version) AS first_version, max(version) AS latest_version FROM log")
def stats(s, d):
    return reads.stats(events_log(s, d))


_SEVENTHS = "SELECT key, version // 7 AS version FROM log"


@_query(f"SELECT version, count(*) AS n FROM ({_SEVENTHS}) GROUP BY version HAVING count(*) > 1")
def version_uniqueness(s, d):
    """A log in which up to seven events share a version."""
    return reads.version_uniqueness(events_log(s, d).withColumn("version", F.expr("version div 7")))


@_query("SELECT version, count(*) AS n FROM log GROUP BY version HAVING count(*) > 1")
def version_uniqueness_of_events(s, d):
    return reads.version_uniqueness(events_log(s, d))


@_query("SELECT key, version, before FROM (SELECT key, version, lag(version) OVER (PARTITION BY key ORDER BY value, version) AS before FROM orders_log) WHERE version <= before")
def version_order_violations(s, d):
    """Rows taken in order of value instead of version."""
    log = orders_log(s, d)
    return reads.version_order_violations(log.withColumn("arrival", F.struct(F.col("value").isNull(), "value", "version")))


@_query("SELECT value, count(*) AS n FROM " + newest(7000, log="orders_log") + " GROUP BY value")
def value_counts(s, d):
    return reads.value_counts(orders_log(s, d), 7000)


# Z order


def _zl(s, d):
    return zfilters.with_z(events_log(s, d), "le4")


def _zf(s, d):
    return zfilters.with_z(events_log(s, d), "fnv")


@_query("SELECT key, version, z FROM zf", HASHED)
def z_encode(s, d):
    return _zf(s, d).select("key", "version", "z")


@_query("SELECT z, key_hash, version FROM zf", HASHED)
def z_decode(s, d):
    return _zf(s, d).select("z", Z.z_key_hash(F.col("z")).alias("key_hash"), Z.z_version(F.col("z")).alias("version"))


_BOUNDS = _spread_cte("(SELECT DISTINCT key, key_hash FROM fnv)", "key_hash", "z_min")


@_query(f"SELECT key, z_min, z_min | 3074457345618258602 * 1 AS z_max FROM ({_BOUNDS})".replace("3074457345618258602 * 1", str(Z.py_spread(2**31 - 1) << 1)), HASHED)
def z_key_bounds(s, d):
    keys = _zf(s, d).select("key", "key_hash").distinct()
    return keys.select("key", Z.z_least(F.col("key_hash")).alias("z_min"), Z.z_greatest(F.col("key_hash")).alias("z_max"))


@_query("SELECT DISTINCT key, key_hash FROM le4", HASHED)
def key_hash_le4(s, d):
    return _zl(s, d).select("key", "key_hash").distinct()


@_query("SELECT DISTINCT key, key_hash FROM fnv", HASHED)
def key_hash_fnv_lo(s, d):
    return _zf(s, d).select("key", "key_hash").distinct()


@_query("SELECT key, version, CAST(key_hash & 15 AS INTEGER) AS shard FROM fnv", HASHED)
def shard_of(s, d):
    return events_log(s, d).select("key", "version", Z.shard_of(F.col("key")).alias("shard"))


@_query("SELECT CAST(key_hash & 15 AS INTEGER) AS shard, count(*) AS rows, count(*) > 600 AS overloaded FROM fnv GROUP BY 1", HASHED)
def shard_load(s, d):
    return compaction.shard_load(events_log(s, d).withColumn("shard", Z.shard_of(F.col("key"))), 800)


@_query("SELECT count(*) FILTER (n > 600) AS overloaded_shards, count(*) FILTER (n > 600) > 0 AS compact, CASE WHEN count(*) FILTER (n > 600) > 8 THEN 1 ELSE 0 END AS priority FROM (SELECT key_hash & 15 AS shard, count(*) AS n FROM fnv GROUP BY 1)", HASHED)
def should_compact(s, d):
    return compaction.should_compact(events_log(s, d).withColumn("shard", Z.shard_of(F.col("key"))), 800)


@_query("SELECT key, version, bucket FROM zl", HASHED)
def z_bucket(s, d):
    return _zl(s, d).select("key", "version", "bucket")


@_query(f"SELECT key, version, z FROM zf WHERE z BETWEEN {1 << 58} AND {1 << 61} AND version <= {V}", HASHED)
def z_range_scan(s, d):
    return zfilters.z_range_scan(_zf(s, d), [(1 << 58, 1 << 61)], V).select("key", "version", "z")


@_query("SELECT key, version, z FROM zf WHERE z = (SELECT max(z) FROM zf)", HASHED)
def z_lookup(s, d):
    log = _zf(s, d)
    return zfilters.z_lookup(log, log.agg(F.max("z")).first()[0]).select("key", "version", "z")


@_query("SELECT key, version, z, row_number() OVER (ORDER BY z, version) - 1 AS place FROM zf", HASHED)
def z_sort(s, d):
    """Written in z order: each row's place among all, from the partitions' sizes and the places in them."""
    laid = zfilters.z_sort(_zf(s, d)).select("key", "version", "z").withColumn("at", F.monotonically_increasing_id())
    _scratch(s)
    laid = laid.checkpoint()
    part = F.shiftrightunsigned("at", 33)
    before, total = {}, 0
    for k, n in sorted(laid.groupBy(part).count().collect()):
        before[k], total = total, total + n
    place = F.create_map(*[F.lit(x).cast("long") for kn in before.items() for x in kn])[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.select("key", "version", "z", place.alias("place"))


_FORWARD, _BACKWARD = zfilters.z_ranges("user:1", "user:3", V), zfilters.z_ranges("user:3", "user:1", V)


def _literal(ranges: list[tuple[int, int]]) -> str:
    low, high = ranges[0] if ranges else (1, 0)
    return f"SELECT key, value FROM {NEWEST.format(rows=f'zf WHERE version <= {V} AND z BETWEEN {low} AND {high}')}"


@_query(_literal(_FORWARD), HASHED)
def tier_literal_scan(s, d):
    """The Z interval between two keys, then the newest row per key: a hash range, not a key range."""
    return reads.snapshot(zfilters.z_range_scan(_zf(s, d), _FORWARD, V))


@_query(_literal(_BACKWARD), HASHED)
def tier_literal_scan_backward(s, d):
    """The same with the keys swapped: of the two, the one whose hashes are out of order is empty."""
    return reads.snapshot(zfilters.z_range_scan(_zf(s, d), _BACKWARD, V))


# Segments, compaction, tiers


@_query("SELECT bucket, count(*) AS rows, min(z) AS z_min, max(z) AS z_max, min(version) AS v_min, max(version) AS v_max FROM zf GROUP BY bucket", HASHED)
def segment_stats(s, d):
    return compaction.segment_stats(_zf(s, d), "bucket")


#: Rows a segment file in the queries on single files.
_FILE_ROWS = 700


def _cut_store(s, d) -> Store:
    """A store of one file for each 700 rows in z order (one partition, so that SQL can tell the files)."""
    store = Store(s, _scratch(s), StoreConfig(max_records_per_file=_FILE_ROWS))
    store.load(events_log(s, d))
    return store


_BY_FILE = f"""SELECT 'hot' AS tier, count(*) AS rows, min(z) AS z_min, max(z) AS z_max, min(version) AS v_min, max(version) AS v_max
FROM (SELECT z, version, (row_number() OVER (ORDER BY z) - 1) // {_FILE_ROWS} AS file FROM zf) GROUP BY file"""


@_query(_BY_FILE, HASHED)
def list_segments(s, d):
    """What the manifest says of each segment file."""
    store = _one_part(s, lambda: _cut_store(s, d))
    return store.list_segments().drop("path")


@_query(f"SELECT * FROM ({_BY_FILE}) WHERE NOT (z_max < {1 << 58} OR z_min > {1 << 59})", HASHED)
def find_segments(s, d):
    """Segment files whose Z range overlaps an interval."""
    store = _one_part(s, lambda: _cut_store(s, d))
    return store.described(store.find_segments(store.manifest().files, 1 << 58, 1 << 59)).drop("path")


def _one_part(s: SparkSession, work):
    """Range partitions are drawn from a sample; with one there is one way to cut files."""
    before = s.conf.get("spark.sql.shuffle.partitions")
    s.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return work()
    finally:
        s.conf.set("spark.sql.shuffle.partitions", before)


@_query(
    """, marked AS (SELECT *, CASE WHEN key_hash IS NOT DISTINCT FROM lag(key_hash) OVER (PARTITION BY bucket ORDER BY z, version) THEN 0 ELSE 1 END AS st FROM zf),
runs AS (SELECT *, sum(st) OVER (PARTITION BY bucket ORDER BY z, version ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT key, version, z FROM (SELECT *, row_number() OVER (PARTITION BY bucket, run ORDER BY version DESC) AS rn FROM runs) WHERE rn = 1""",
    HASHED,
)
def compact_adjacent(s, d):
    return compaction.compact_adjacent(_zf(s, d)).select("key", "version", "z")


def _compacted(floor: int) -> str:
    return f"SELECT key, version, value, deleted FROM log WHERE version > {floor} UNION ALL SELECT key, version, value, deleted FROM {newest(floor)}"


@_query(_compacted(FLOOR))
def compact_latest(s, d):
    return compaction.compact_latest(events_log(s, d), FLOOR)


def _tiers(s, d) -> list[DataFrame]:
    log = events_log(s, d)
    return [log.filter(F.col("version") >= 4000), log.filter(F.col("version") < 4000)]


@_query(f"SELECT key, version, value FROM {newest(V, f'''key = '{KEY}' ''')}")
def tier_get(s, d):
    return tiers.tier_get(_tiers(s, d), KEY, V)


@_query(_scan(START, END))
def tier_scan(s, d):
    return tiers.tier_scan(_tiers(s, d), START, END, V)


@_query("SELECT count(*) AS total, count(*) FILTER (version >= 8000) AS hot, count(*) FILTER (version >= 4000 AND version < 8000) AS warm, count(*) FILTER (version < 4000) AS cold FROM log")
def tier_stats(s, d):
    return tiers.tier_stats(tiers.assign_tier(events_log(s, d), 8000, 4000))


# Writes and transactions

_PUTS = "(SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value, c_custkey FROM customer)"


def _customers(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), "c_custkey")


def _base(log: DataFrame) -> int:
    return reads.latest_version(log).first()[0]


@_query(f"SELECT key, version, value, deleted FROM log UNION ALL SELECT key, (SELECT max(version) FROM log) + row_number() OVER (ORDER BY c_custkey), value, FALSE FROM {_PUTS}")
def put_batch(s, d):
    log = events_log(s, d)
    return writes.put_batch(log, _customers(s, d), _base(log), "c_custkey")


@_query(f"SELECT key, version, value, deleted FROM log UNION ALL SELECT key, (SELECT max(version) FROM log) + row_number() OVER (ORDER BY c_custkey), NULL, TRUE FROM {_PUTS}")
def delete_batch(s, d):
    log = events_log(s, d)
    return writes.delete_batch(log, _customers(s, d), _base(log), "c_custkey")


#: Hashes that make up a wide value: 8 kB that do not compress, so that a batch fills several partitions.
_WIDE = 128


def _wide(s, d) -> DataFrame:
    orders = s.read.parquet(f"{d}/orders.parquet")
    value = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda i: F.sha2(F.concat_ws("-", F.col("o_orderkey"), i).cast("binary"), 256)))
    return orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), value.alias("value"), "o_orderkey")


@_query(
    f"SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS key, 7 + row_number() OVER (ORDER BY o_orderkey DESC) AS version, {64 * _WIDE} AS size, sha256(CAST(o_orderkey AS VARCHAR) || '-{_WIDE - 1}') AS tail FROM orders"
)
def put_batch_wide(s, d):
    """Versions of a batch of 8 kB values, written in full over several partitions."""
    puts = _wide(s, d).select("key", "value", (-F.col("o_orderkey")).alias("back"))
    rows = writes.put_rows(puts, 7, "back")
    return rows.select("key", "version", F.length("value").alias("size"), F.substring("value", 64 * (_WIDE - 1) + 1, 64).alias("tail"))


@_query("SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS key, 7 + row_number() OVER (ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '-0')) AS version, TRUE AS deleted FROM orders")
def delete_batch_wide(s, d):
    """Tombstones numbered in the order of the wide values."""
    return writes.delete_rows(_wide(s, d), 7, "value").select("key", "version", "deleted")


@_query("SELECT key, version, value, deleted FROM log UNION ALL SELECT key, (SELECT max(version) FROM log) + 1, value, FALSE FROM (SELECT 'user:' || CAST(c_custkey % 50 AS VARCHAR) AS key, c_mktsegment AS value, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn = 1")
def txn_commit(s, d):
    log = events_log(s, d)
    puts = s.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("user:"), (F.col("c_custkey") % 50).cast("string")).alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").alias("seq")
    )
    return writes.txn_commit(log, puts, _base(log))


@_query("SELECT key, version, value, deleted FROM log WHERE NOT (version % 2 = 0 AND key < 'user:5')")
def txn_remove_if(s, d):
    return writes.txn_remove_if(events_log(s, d), (F.col("version") % 2 == 0) & (F.col("key") < "user:5"))


# Store and stream


def _delete_scratch(spark: SparkSession, path: str) -> None:
    try:
        _Files(spark).delete(path)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    atexit.register(_delete_scratch, spark, path)
    return path


@_query(f"SELECT key, value FROM {newest(V)}")
def store_snapshot(s, d):
    """Written to segment files, committed, and read back through the manifest."""
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    return store.snapshot(V)


@_query(f"SELECT key, version, value FROM {newest(V, f'''key = '{KEY}' ''')}")
def store_get(s, d):
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    return store.get(KEY, V)


@_query(_scan(START, END))
def store_scan(s, d):
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    return store.scan(START, END, V)


@_query(f"{_HISTORY} AND version BETWEEN 100 AND {V}")
def store_history(s, d):
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    return store.history(KEY, 100, V)


@_query(f"SELECT key, value FROM {newest()} WHERE key NOT IN ('user:1', 'user:2') UNION ALL SELECT 'user:1', 'last'")
def store_transaction(s, d):
    """A batch of edits at one version: of a key's edits the last counts."""
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    edits = store.begin_write()
    edits.insert("user:1", "first")
    edits.insert("user:1", "last")
    edits.delete("user:2")
    edits.commit()
    return store.snapshot()


@_query(_compacted(FLOOR))
def store_compact(s, d):
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    store.compact(FLOOR)
    return store.log(tier="cold").select(*SCHEMA.names)


def _loaded(s, d) -> Store:
    store = Store(s, _scratch(s))
    store.load(events_log(s, d))
    return store


@_query(f"SELECT key, version, value FROM {newest(V, _ASKED)}")
def store_multi_get(s, d):
    keys = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return _loaded(s, d).multi_get(keys, V)


@_query(f"SELECT key, value, 'pinned' AS seen FROM {newest()} UNION ALL SELECT 'user:1', 'later', 'after'")
def store_read_txn(s, d):
    """Reads on the manifest that a transaction began with, beside what was written since."""
    store = _loaded(s, d)
    reader = store.begin_read()
    store.put("user:1", "later")
    return reader.snapshot().withColumn("seen", F.lit("pinned")).unionByName(store.scan("user:1", "user:1 ").withColumn("seen", F.lit("after")))


@_query(f"{_HISTORY} AND version > {FLOOR}")
def store_history_floor(s, d):
    """History above the retention floor of a compacted store; one that begins below it is refused."""
    store = _loaded(s, d)
    store.compact(FLOOR)
    try:
        store.history(KEY, 1)
    except VersionNotFound:
        return store.history(KEY, min(FLOOR + 1, store.latest_version()))
    return store.history(KEY).limit(0)


@_query(f"SELECT key, version, value FROM {newest(None, f'version > {FLOOR}')} UNION ALL SELECT 'late', 1, 'late'")
def store_late_rows(s, d):
    """Rows at or below the floor of a compacted store are refused, or set aside when they come in a stream."""
    store = _loaded(s, d)
    store.compact(FLOOR)
    late = s.createDataFrame([("late", 1, "late", False)], SCHEMA)
    try:
        store.append(lambda base: late)
    except LateRows:
        store.append(lambda base: late, stream=("late", 0))
    live = reads.latest_per_key(store.changes(min(FLOOR, store.latest_version()))).select("key", "version", "value")
    return live.unionByName(store.late_rows().select("key", "version", "value"))


@_query(f"SELECT key, value FROM {newest()}")
def store_vacuum(s, d):
    """Compacted and vacuumed of all but the last manifest."""
    store = _loaded(s, d)
    store.compact(FLOOR)
    store.vacuum(keep=1, grace=0)
    return store.snapshot()


@_query(f"SELECT key, version, z FROM zf WHERE z BETWEEN {1 << 58} AND {1 << 61} AND version <= {V}", HASHED)
def store_z_range(s, d):
    return _loaded(s, d).z_range_scan([(1 << 58, 1 << 61)], V).select("key", "version", "z")


@_query("SELECT key, version, z FROM zf WHERE z = (SELECT max(z) FROM zf)", HASHED)
def store_z_lookup(s, d):
    store = _loaded(s, d)
    return store.z_lookup(max((f["z_max"] for f in store.manifest().files), default=0)).select("key", "version", "z")


@_query("SELECT count(*) AS entries, count(*) FILTER (deleted) AS tombstones, count(DISTINCT key) AS keys, min(version) AS first_version, max(version) AS latest_version FROM log")
def store_stats(s, d):
    return _loaded(s, d).stats()


@_query(f"SELECT key, version, value, deleted FROM log WHERE version > 2000 AND version <= {V}")
def store_changes(s, d):
    return _loaded(s, d).changes(2000, V)


@_query(f"SELECT key, value FROM {newest(FLOOR)}")
def store_compact_range(s, d):
    """Half of the files compacted at a floor; reads at it are as before."""
    store = _cut_store(s, d)
    store.compact(FLOOR, (0, 1 << 60))
    return store.snapshot(min(FLOOR, store.latest_version()))


@_query(f"SELECT hex(encode('a' || chr(0)) || from_hex('FF80')) AS key, hex(encode(value)) AS value FROM {newest(V)} WHERE key = '{KEY}'")
def store_binary(s, d):
    """Keys and values that are bytes and no UTF-8."""
    store = Store(s, _scratch(s), StoreConfig(binary=True))
    key = bytearray(b"a\x00\xff\x80")
    log = events_log(s, d).filter(F.col("key") == KEY)
    store.load(log.select(F.lit(key).alias("key"), "version", F.col("value").cast("binary").alias("value"), "deleted"))
    return store.get(key, V).select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@_query(_compacted(FLOOR))
def stream_compact(s, d):
    """Streamed into a store batch by batch, then compacted."""
    where = _scratch(s)
    store = Store(s, where)
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = stream.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        (F.col("event_id") + 1).alias("version"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
        (F.col("event_type") == "error").alias("deleted"),
    )
    ingest(log, store, f"{where}/checkpoint", availableNow=True).awaitTermination()
    store.compact(FLOOR)
    return store.log().select(*SCHEMA.names)


# Beyond the verbs


@_query(
    """, probes AS (SELECT c_custkey AS probe_id, 'user:' || CAST(c_custkey % 200 AS VARCHAR) AS key, CAST(c_custkey * 7 % 9000 AS BIGINT) AS "at" FROM customer),
met AS (SELECT p.probe_id, p.key, p."at", l.version, l.value, l.deleted, row_number() OVER (PARTITION BY p.probe_id ORDER BY l.version DESC) AS rn
  FROM probes p LEFT JOIN log l ON l.key = p.key AND l.version <= p."at")
SELECT probe_id, key, "at", CASE WHEN NOT deleted THEN version END AS version, CASE WHEN NOT deleted THEN value END AS value FROM met WHERE rn = 1"""
)
def as_of_join(s, d):
    probes = s.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").alias("probe_id"), F.concat(F.lit("user:"), (F.col("c_custkey") % 200).cast("string")).alias("key"), (F.col("c_custkey") * 7 % 9000).cast("long").alias("at")
    )
    return reads.as_of_join(probes, events_log(s, d))


@_query(
    f"""SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change,
o.value AS old_value, n.value AS new_value FROM {newest(2000)} o FULL JOIN {newest(V)} n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value"""
)
def snapshot_diff(s, d):
    return reads.snapshot_diff(events_log(s, d), 2000, V)


@_query(f"SELECT key, version, value, deleted FROM log WHERE version > 2000 AND version <= {V}")
def change_feed(s, d):
    return reads.change_feed(events_log(s, d), 2000, V)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
