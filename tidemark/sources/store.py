"""A store of immutable segment files under numbered manifests.

    data/<commit>/*.parquet      segment files, sorted by z within each file
    manifest/<n>.json            the files that version n of the store consists of
    late/<commit>/*.parquet      streamed rows that came below the retention floor

A commit writes its files first, then its manifest aside, and then gives the
manifest its number without overwriting: of two writers one wins and the other
tries again on top.  So a manifest is whole as soon as it can be seen, and readers
hold the one they began with.  All files are reached through Spark's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import zorder as Z
from ..operators import compaction, reads, writes
from ..plans import zfilters
from .changelog import VERSION_LIMIT, open_log, schema_of

#: Format of manifests; manifests that a vacuum keeps, and seconds for which it keeps
#: files that no manifest names, as a commit may be about to.
FORMAT, KEPT_MANIFESTS, GRACE = 2, 10, 24 * 3600.0


class StoreError(Exception):
    """Any failure of a store."""


class VersionNotFound(StoreError):
    """A read below the retention floor."""


class CorruptStore(StoreError):
    """A manifest that cannot be read."""


class UnknownFormat(CorruptStore):
    """A manifest of another format."""


class LateRows(StoreError):
    """Rows to be appended whose versions are not above the retention floor."""


class ConflictError(StoreError):
    """Another writer took the manifest number, again and again."""


@dataclass
class StoreConfig:
    """Layout of a store: rows a file and bytes of a row group, the hash behind z,
    retries of a commit, and whether keys and values are bytes instead of text."""

    max_records_per_file: int = 1_000_000
    block_bytes: int = 128 << 20
    binary: bool = False
    key_hash: str = "fnv"
    retries: int = 8
    shards: int = 16
    workers: int = 4


@dataclass
class Manifest:
    n: int = 0
    max_version: int = 0
    retention_floor: int = 0
    files: list[dict] = field(default_factory=list)
    #: The last batch of each stream that is in the files.
    streams: dict[str, int] = field(default_factory=dict)
    format: int = FORMAT


class _Files:
    """The few file operations that a store needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def names(self, path: str) -> list[str]:
        system, at = self._at(path)
        return [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []

    def read(self, path: str) -> str:
        system, at = self._at(path)
        stream = system.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Give a whole new file its name; False if that is taken.

        The bytes are written aside first.  On a local file system a hard link
        takes the name, elsewhere a rename that does not overwrite.
        """
        folder, name = path.rsplit("/", 1)
        system, aside = self._at(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = system.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, at = self._at(path)
        try:
            if system.getUri().getScheme() == "file":
                local = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(at), local(aside))
            else:
                options = self.jvm.org.apache.hadoop.fs.Options
                none = self.gateway.new_array(options.Rename, 1)
                none[0] = options.Rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.conf).rename(aside, at, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            system.delete(aside, False)

    def aged(self, path: str, seconds: float) -> list[str]:
        """Names of what has not changed for so many seconds."""
        system, at = self._at(path)
        before = 1000 * (time.time() - seconds)
        return [x.getPath().getName() for x in system.listStatus(at) if x.getModificationTime() <= before] if system.exists(at) else []

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)


class Store:
    """put, delete, get, scan, history and snapshot over committed segment files."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or StoreConfig()
        self.files, self.schema = _Files(spark), schema_of(self.config.binary)
        self.names = self.schema.names

    # manifests

    def manifest_numbers(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.files.names(f"{self.path}/manifest") if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, n: int | None = None) -> Manifest:
        """A manifest by number, or the newest that is whole.

        A newest manifest that is no whole JSON was damaged after it appeared; readers
        go on with the one before and are warned, writers stop until ``repair``.
        """
        numbers = self.manifest_numbers()
        if n is not None:
            if n in numbers:
                return self._read_manifest(n)
            if n == 0:
                return Manifest()
            raise VersionNotFound(f"manifest {n}")
        for k in reversed(numbers):
            try:
                return self._read_manifest(k)
            except UnknownFormat:
                raise
            except CorruptStore as e:
                warnings.warn(f"{self.path}: {e}", stacklevel=2)
        if numbers:
            raise CorruptStore("no manifest can be read")
        return Manifest()

    def _read_manifest(self, n: int) -> Manifest:
        try:
            found = json.loads(self.files.read(f"{self.path}/manifest/{n}.json"))
            if found.get("format") != FORMAT:
                raise UnknownFormat(f"manifest {n}: format {found.get('format')}, not {FORMAT}")
            return Manifest(**found)
        except (ValueError, TypeError, AttributeError) as e:
            raise CorruptStore(f"manifest {n}: {e}") from e

    def repair(self) -> list[int]:
        """Delete newest manifests that cannot be read; their numbers."""
        gone, whole = [], self.manifest().n
        for n in [x for x in self.manifest_numbers() if x > whole]:
            self.files.delete(f"{self.path}/manifest/{n}.json")
            gone.append(n)
        return gone

    def _publish(self, manifest: Manifest) -> bool:
        return self.files.create(f"{self.path}/manifest/{manifest.n}.json", json.dumps(asdict(manifest)))

    # segments

    def write_segments(self, rows: DataFrame, tier: str) -> list[dict]:
        """Write rows in z order; a description of each file with the ranges it covers."""
        where = f"{self.path}/data/{uuid.uuid4().hex}"
        laid = zfilters.z_sort(zfilters.with_z(rows, self.config.key_hash, self.config.workers)).drop("bucket")
        laid.write.option("maxRecordsPerFile", self.config.max_records_per_file).option("parquet.block.size", self.config.block_bytes).parquet(where)
        written = self.spark.read.schema(laid.schema).parquet(where)
        stats = compaction.segment_stats(written.withColumn("path", F.input_file_name()), "path").collect()
        out = [r.asDict() | {"tier": tier, "path": r["path"]} for r in stats]
        if any(f["v_max"] >= VERSION_LIMIT for f in out):
            raise StoreError(f"versions end below {VERSION_LIMIT}")
        return out

    def read_segments(self, files: list[dict]) -> DataFrame:
        if not files:
            return open_log(self.spark, self.config.binary).select(*self.names, F.lit(0).cast("long").alias("key_hash"), F.lit(0).cast("long").alias("z"))
        schema = T.StructType([*self.schema.fields, T.StructField("key_hash", T.LongType()), T.StructField("z", T.LongType())])
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in files])

    @staticmethod
    def find_segments(files: list[dict], z_low: int, z_high: int) -> list[dict]:
        return [f for f in files if not (f["z_max"] < z_low or f["z_min"] > z_high)]

    def log(self, n: int | None = None, tier: str | None = None) -> DataFrame:
        found = self.manifest(n).files
        return self.read_segments([f for f in found if tier is None or f["tier"] == tier])

    def list_segments(self, n: int | None = None) -> DataFrame:
        """A row per segment file: path, tier, rows and the ranges it covers."""
        return self.described(self.manifest(n).files)

    def described(self, files: list[dict]) -> DataFrame:
        schema = "path string, tier string, rows long, z_min long, z_max long, v_min long, v_max long"
        names = [x.split()[0] for x in schema.split(", ")]
        return self.spark.createDataFrame([tuple(f[x] for x in names) for f in files], schema)

    def shard_load(self, capacity: int) -> DataFrame:
        """Hot rows by shard, and whether they exceed three quarters of a shard's capacity."""
        return compaction.shard_load(self.log(tier="hot").withColumn("shard", Z.shard_of(F.col("key"), self.config.shards)), capacity)

    def flush(self) -> int:
        """A commit is durable when it returns, so there is nothing to flush: the latest version."""
        return self.latest_version()

    close = flush

    # reading: the newest manifest, or that of number ``n``

    def begin_read(self, n: int | None = None) -> ReadTransaction:
        return ReadTransaction(self, self.manifest(n))

    def get(self, key, version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).get(key, version)

    def scan(self, start=None, end=None, version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).scan(start, end, version)

    def prefix_scan(self, prefix, version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).prefix_scan(prefix, version)

    def snapshot(self, version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).scan(None, None, version)

    def history(self, key, start: int | None = None, end: int | None = None, tombstones: bool = False, n: int | None = None) -> DataFrame:
        return self.begin_read(n).history(key, start, end, tombstones)

    def multi_get(self, keys: DataFrame, version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).multi_get(keys, version)

    def z_lookup(self, z: int, n: int | None = None) -> DataFrame:
        return self.begin_read(n).z_range_scan([(z, z)])

    def z_range_scan(self, ranges: list[tuple[int, int]], version: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).z_range_scan(ranges, version)

    def changes(self, after: int, until: int | None = None, n: int | None = None) -> DataFrame:
        return self.begin_read(n).changes(after, until)

    def stats(self, n: int | None = None) -> DataFrame:
        return self.begin_read(n).stats()

    def latest_version(self) -> int:
        return self.manifest().max_version

    def next_version(self) -> int:
        return self.latest_version() + 1

    def count(self) -> int:
        """Entries, tombstones included, from the manifest alone."""
        return sum(f["rows"] for f in self.manifest().files)

    def tier_stats(self) -> dict[str, int]:
        files = self.manifest().files
        by = {t: sum(f["rows"] for f in files if f["tier"] == t) for t in ("hot", "warm", "cold")}
        return {"total": sum(by.values()), **by}

    # writing

    def append(self, make, stream: tuple[str, int] | None = None) -> int:
        """Commit the rows that ``make(base version)`` gives; the latest version after it.

        Rows whose versions are not above the retention floor would change what
        compaction has settled (a deleted key could come back): ``LateRows``.  Of a
        ``stream`` (its name and the number of its batch) such rows are put in
        ``late`` instead, and a batch that the manifest has already is not repeated.
        """
        for _ in range(self.config.retries):
            before = self.manifest()
            if stream and before.streams.get(stream[0], -1) >= stream[1]:
                return before.max_version
            rows = make(before.max_version)
            if stream:
                late = rows.filter(F.col("version") <= before.retention_floor)
                if before.retention_floor and not late.isEmpty():
                    late.write.mode("overwrite").parquet(f"{self.path}/late/{uuid.uuid5(uuid.NAMESPACE_URL, stream[0]).hex}-{stream[1]}")
                rows = rows.filter(F.col("version") > before.retention_floor)
            files = self.write_segments(rows, "hot")
            if any(f["v_min"] <= before.retention_floor for f in files):
                raise LateRows(f"versions must be above the retention floor {before.retention_floor}")
            latest = max([before.max_version, *(f["v_max"] for f in files)])
            streams = before.streams | ({stream[0]: stream[1]} if stream else {})
            if self._publish(Manifest(before.n + 1, latest, before.retention_floor, before.files + files, streams)):
                return latest
        raise ConflictError("too many writers")

    def late_rows(self) -> DataFrame:
        """Streamed rows that came too late."""
        names = self.files.names(f"{self.path}/late")
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/late/{x}" for x in names]) if names else open_log(self.spark, self.config.binary)

    def put_batch(self, puts: DataFrame, *order: str) -> int:
        """Put rows of (key, value), a version each."""
        return self.append(lambda base: writes.put_rows(puts, base, *order))

    def delete_batch(self, keys: DataFrame, *order: str) -> int:
        return self.append(lambda base: writes.delete_rows(keys, base, *order))

    def _rows(self, rows: list[tuple], *names: str) -> DataFrame:
        return self.spark.createDataFrame(rows, T.StructType([self.schema[x] for x in names]))

    def put(self, key, value) -> int:
        return self.append(lambda base: self._rows([(key, base + 1, value, False)], *self.names))

    def delete(self, key) -> int:
        return self.append(lambda base: self._rows([(key, base + 1, None, True)], *self.names))

    def load(self, log: DataFrame) -> int:
        """Append changelog rows with versions of their own, all above the latest."""
        def rows(base: int) -> DataFrame:
            if log.filter(F.col("version") <= base).limit(1).count():
                raise StoreError(f"versions must be above {base}")
            return log.select(*self.names)

        return self.append(rows)

    def begin_write(self) -> WriteTransaction:
        return WriteTransaction(self, self.manifest())

    # upkeep

    def compact(self, floor: int | None = None, z_range: tuple[int, int] | None = None) -> int:
        """Rewrite files as cold ones and drop what no read at ``floor`` or later sees; rows written.

        The floor goes no further than the latest version.  ``z_range`` takes only the
        files that overlap it; tombstones stay then, as older rows of their keys may lie
        in other files.  If other writers only added files above the floor meanwhile,
        those are kept beside the rewritten ones and nothing is done again.
        """
        for _ in range(self.config.retries):
            before = self.manifest()
            at = max(before.retention_floor, min(floor or 0, before.max_version))
            taken = before.files if z_range is None else self.find_segments(before.files, *z_range)
            if z_range is not None and not taken:
                return 0
            rows = self.read_segments(taken).select(*self.names)
            files = self.write_segments(compaction.compact_latest(rows, at, len(taken) < len(before.files)), "cold")
            paths = {f["path"] for f in taken}
            for _ in range(self.config.retries):
                now = self.manifest()
                rest = [f for f in now.files if f["path"] not in paths]
                known = {f["path"] for f in before.files}
                if len(rest) + len(taken) != len(now.files) or now.retention_floor > at or any(f["v_min"] <= at for f in rest if f["path"] not in known):
                    break
                if self._publish(Manifest(now.n + 1, now.max_version, at, rest + files, now.streams)):
                    return sum(f["rows"] for f in files)
        raise ConflictError("too many writers")

    def should_compact(self, capacity: int, share: float = 0.75) -> bool:
        """Whether the hot rows exceed a share of the shards' capacity."""
        return sum(f["rows"] for f in self.manifest().files if f["tier"] == "hot") > capacity * self.config.shards * share

    def vacuum(self, keep: int = KEPT_MANIFESTS, grace: float = GRACE) -> int:
        """Drop all but the last manifests, and the folders that none of those names.

        Folders that changed in the last ``grace`` seconds stay: they may belong to
        a commit whose manifest is still to come.
        """
        old = self.files.aged(f"{self.path}/data", grace)
        numbers = self.manifest_numbers()
        for n in numbers[:-keep] if keep < len(numbers) else []:
            self.files.delete(f"{self.path}/manifest/{n}.json")
        used = {f["path"].rsplit("/", 2)[1] for n in self.manifest_numbers() for f in self.manifest(n).files}
        gone = [x for x in old if x not in used]
        for name in gone:
            self.files.delete(f"{self.path}/data/{name}")
        return len(gone)


class ReadTransaction:
    """Reads that stay with one manifest, and open only files that can matter to them."""

    def __init__(self, store: Store, manifest: Manifest) -> None:
        self.store, self.manifest, self.epoch, self.version = store, manifest, manifest.n, manifest.max_version

    @property
    def data(self) -> DataFrame:
        return self.store.read_segments(self.manifest.files).select(*self.store.names)

    def _until(self, version: int | None) -> int:
        if version is not None and version < self.manifest.retention_floor:
            raise VersionNotFound(f"version {version} is below the retention floor {self.manifest.retention_floor}")
        return min(self.version if version is None else version, VERSION_LIMIT - 1)

    def files(self, at: int, ranges: list[tuple[int, int]] | None = None) -> list[dict]:
        """Files with rows up to a version and, if given, in any of the Z ranges."""
        found = [f for f in self.manifest.files if f["v_min"] <= at]
        return found if ranges is None else [f for f in found if any(self.store.find_segments([f], *r) for r in ranges)]

    def _of_key(self, key, at: int) -> DataFrame:
        kind = self.store.config.key_hash
        rows = self.store.read_segments(self.files(at, [zfilters.key_interval(key, at, kind)]))
        return rows.filter(zfilters.key_filter(key, at, kind))

    def get(self, key, version: int | None = None) -> DataFrame:
        at = self._until(version)
        return reads.get_as_of(self._of_key(key, at), key, at)

    def scan(self, start=None, end=None, version: int | None = None) -> DataFrame:
        at = self._until(version)
        return reads.scan_as_of(self.store.read_segments(self.files(at)), start, end, at)

    def prefix_scan(self, prefix, version: int | None = None) -> DataFrame:
        at = self._until(version)
        return reads.prefix_scan(self.store.read_segments(self.files(at)), prefix, at)

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self.scan(None, None, version)

    def history(self, key, start: int | None = None, end: int | None = None, tombstones: bool = False) -> DataFrame:
        """As ``reads.history``.  An open start is the earliest row that is retained; a
        start below the retention floor, whose rows may be gone, is an error."""
        if start is not None and max(start, 1) < self.manifest.retention_floor:
            raise VersionNotFound(f"version {start} is below the retention floor {self.manifest.retention_floor}")
        at = self._until(end)
        return reads.history(self._of_key(key, at), key, start, at, tombstones)

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        at = self._until(version)
        return reads.multi_get(self.store.read_segments(self.files(at)), keys, at)

    def z_lookup(self, z: int) -> DataFrame:
        return self.z_range_scan([(z, z)])

    def z_range_scan(self, ranges: list[tuple[int, int]], version: int | None = None) -> DataFrame:
        """All rows in any of the closed Z ranges up to a version, nothing removed."""
        at = self._until(version)
        return zfilters.z_range_scan(self.store.read_segments(self.files(at, ranges)), ranges, at)

    def changes(self, after: int, until: int | None = None) -> DataFrame:
        """All rows of versions in (after, until]; those at or below the floor may be gone."""
        if after < self.manifest.retention_floor:
            raise VersionNotFound(f"version {after} is below the retention floor {self.manifest.retention_floor}")
        at = self._until(until)
        files = [f for f in self.files(at) if f["v_max"] > after]
        return reads.change_feed(self.store.read_segments(files), after, at)

    def stats(self) -> DataFrame:
        return reads.stats(self.data)


class WriteTransaction:
    """A batch of edits that becomes visible at once, at one version."""

    def __init__(self, store: Store, manifest: Manifest) -> None:
        self.store, self.before, self.edits, self.removed = store, manifest, [], []

    @property
    def version(self) -> int:
        return self.before.max_version + 1

    def insert(self, key, value) -> None:
        self.edits.append((key, value, False))

    def delete(self, key) -> None:
        self.edits.append((key, None, True))

    def remove_if(self, predicate: Column) -> None:
        """Drop rows of the log that the predicate holds for."""
        self.removed.append(predicate)

    def commit(self) -> int:
        """Publish; of a key's edits the last counts.  Fails if another commit came between."""
        store, last = self.store, {k: (k, self.version, v, d) for k, v, d in self.edits}
        files = list(self.before.files)
        if self.removed:
            rows = store.read_segments(files).select(*store.names)
            for predicate in self.removed:
                rows = writes.txn_remove_if(rows, predicate)
            files = store.write_segments(rows, "hot")
        if last:
            files += store.write_segments(store._rows(list(last.values()), *store.names), "hot")
        if not store._publish(Manifest(self.before.n + 1, self.version, self.before.retention_floor, files, self.before.streams)):
            raise ConflictError(f"manifest {self.before.n + 1} is taken")
        return self.version

    def rollback(self) -> None:
        self.edits.clear()
        self.removed.clear()
