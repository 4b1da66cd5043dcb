"""The store: commits, snapshots, conflicts, compaction, vacuum, streams and the command line."""

import pytest

from tidemark import cli
from tidemark.sources.changelog import SCHEMA
from tidemark.sources.store import ConflictError, CorruptStore, LateRows, Manifest, Store, StoreConfig, UnknownFormat, VersionNotFound
from tidemark.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", StoreConfig(max_records_per_file=50))


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def value(df):
    rows = df.collect()
    return rows[0]["value"] if rows else None


def test_verbs(store):
    assert store.latest_version() == 0 and store.snapshot().count() == 0 and store.get("key1").count() == 0
    assert store.put("key1", "value1") == 1
    assert store.put("key2", "value2") == 2
    assert store.put("key1", "updated") == 3
    assert store.delete("key1") == 4
    assert value(store.get("key1")) is None
    assert value(store.get("key1", 1)) == "value1"
    assert value(store.get("key1", 3)) == "updated"
    assert store.delete("nobody") == 5
    assert pairs(store.scan("key1", "key3", 3)) == [("key1", "updated"), ("key2", "value2")]
    assert [tuple(r) for r in store.history("key1", tombstones=True).collect()] == [(1, "value1", False), (3, "updated", False), (4, "", True)]
    assert store.count() == 5 and store.next_version() == 6
    again = Store(store.spark, store.path)
    assert again.latest_version() == 5 and value(again.get("key2")) == "value2"


def test_segments_are_pruned(store, spark):
    store.put_batch(spark.createDataFrame([(f"k{i}", str(i)) for i in range(500)], "key string, value string"))
    files = store.manifest().files
    assert len(files) > 3 and sum(f["rows"] for f in files) == 500
    from tidemark.plans.zfilters import key_interval

    hit = store.find_segments(files, *key_interval("k77", 500, "fnv"))
    assert 1 <= len(hit) < len(files)
    assert value(store.get("k77")) == "77"
    plan = spark._jvm.PythonSQLUtils.explainString(store.get("k77")._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(z" in plan and "LessThanOrEqual(version" in plan


def test_transactions(store):
    store.put("a", "1")
    reader, first, second = store.begin_read(), store.begin_write(), store.begin_write()
    first.insert("b", "2")
    first.insert("b", "3")
    first.delete("a")
    assert first.commit() == 2
    assert [r["key"] for r in reader.data.collect()] == ["a"]
    second.insert("c", "4")
    with pytest.raises(ConflictError):
        second.commit()
    assert pairs(store.snapshot()) == [("b", "3")]
    from pyspark.sql import functions as F

    third = store.begin_write()
    third.remove_if(F.col("key") == "b")
    third.commit()
    assert pairs(store.snapshot()) == [] and store.latest_version() == 3


def test_two_writers_on_one_number(store):
    assert store._publish(Manifest(1, 1, 0, []))
    assert not store._publish(Manifest(1, 2, 0, []))


def test_compaction_and_vacuum(store, spark):
    for i in range(4):
        store.put_batch(spark.createDataFrame([("a", f"a{i}"), ("b", f"b{i}")], "key string, value string"))
    store.delete("a")
    assert store.tier_stats() == {"total": 9, "hot": 9, "warm": 0, "cold": 0}
    before = pairs(store.snapshot(7))
    assert store.compact(7) == 4
    assert pairs(store.snapshot(7)) == before and pairs(store.snapshot()) == [("b", "b3")]
    assert store.tier_stats()["cold"] == 4
    with pytest.raises(VersionNotFound):
        store.snapshot(3)
    assert store.put("c", "1") == 10
    assert store.vacuum(keep=1) == 0
    assert store.vacuum(keep=1, grace=0) > 0
    assert pairs(store.snapshot()) == [("b", "b3"), ("c", "1")]


def test_stream(store, spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"k{j}", 10 * i + j + 1, f"{i}", False) for j in range(5)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ingest(stream, store, f"{tmp_path}/check", compact_over=8, floor=0, availableNow=True).awaitTermination()
    assert store.count() == 15
    assert pairs(store.snapshot()) == [(f"k{j}", "2") for j in range(5)]
    assert pairs(store.snapshot(15)) == [(f"k{j}", "1") for j in range(5)]


def test_command_line(spark, tmp_path, capsys):
    run = lambda *words: cli.main(["--path", f"file://{tmp_path}/cli", *words], spark)
    run("put", "k", "v1")
    run("put", "k", "v2")
    run("get", "k", "1")
    run("get", "nobody")
    run("delete", "k")
    run("history", "k")
    run("scan", "-", "-", "2")
    run("version")
    out = capsys.readouterr().out
    for line in ("version 1", "version 2", "v1", "Key not found", "3\t(deleted)", "3 rows", "k\tv2", "1 rows", "tidemark "):
        assert line in out


def test_vacuum_spares_a_commit_in_flight(store):
    store.put("a", "1")
    files = store.write_segments(store._rows([("b", 2, "2", False)], *store.names), "hot")
    assert store.vacuum(keep=1) == 0
    assert store._publish(Manifest(2, 2, 0, store.manifest().files + files))
    assert pairs(store.snapshot()) == [("a", "1"), ("b", "2")]


def test_history_below_the_floor(store):
    for k in range(1, 5):
        store.put("a", str(k))
    store.compact(3)
    for start in (1, 2):
        with pytest.raises(VersionNotFound):
            store.history("a", start, 4)
    assert [r["version"] for r in store.history("a", 3, 4).collect()] == [3, 4]
    assert [r["version"] for r in store.history("a").collect()] == [3, 4]
    with pytest.raises(VersionNotFound):
        store.changes(2)


def test_late_rows_do_not_bring_a_key_back(store, spark):
    store.load(spark.createDataFrame([("x", 4, "4", False), ("x", 5, None, True), ("y", 6, "6", False)], SCHEMA))
    store.compact(100)
    assert store.manifest().retention_floor == 6
    late = spark.createDataFrame([("x", 2, "2", False), ("z", 9, "9", False)], SCHEMA)
    with pytest.raises(LateRows):
        store.append(lambda base: late)
    assert pairs(store.snapshot()) == [("y", "6")]
    store.append(lambda base: late, stream=("s", 0))
    assert pairs(store.snapshot()) == [("y", "6"), ("z", "9")]
    assert pairs(store.late_rows()) == [("x", "2")]
    store.append(lambda base: late, stream=("s", 0))
    assert store.count() == 2 and store.manifest().streams == {"s": 0}


def test_a_repeated_batch_is_committed_once(store, spark, tmp_path):
    """The manifest holds the batch; the checkpoint forgot that it was done."""
    spark.createDataFrame([("k", 1, "1", False)], SCHEMA).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ingest(stream, store, f"{tmp_path}/check", availableNow=True).awaitTermination()
        for mark in (tmp_path / "check" / "commits").iterdir():
            mark.unlink()
    assert store.count() == 1


def test_manifests_are_whole_or_absent(store):
    store.put("a", "1")
    assert not [x for x in store.files.names(f"{store.path}/manifest") if x.startswith(".1")]
    assert not store.files.create(f"{store.path}/manifest/1.json", "other") and pairs(store.snapshot()) == [("a", "1")]
    store.put("a", "2")
    assert store.files.create(f"{store.path}/manifest/3.json", "{torn")
    with pytest.warns(UserWarning):
        assert pairs(store.snapshot()) == [("a", "2")]
    with pytest.raises(CorruptStore):
        store.manifest(3)
    with pytest.warns(UserWarning):
        assert store.repair() == [3]
    assert store.put("a", "3") == 3
    store.files.create(f"{store.path}/manifest/4.json", '{"format": 1, "n": 4}')
    with pytest.raises(UnknownFormat):
        store.snapshot()


def test_pinned_reads(store, spark):
    store.put("a", "1")
    pinned, n = store.begin_read(), store.manifest().n
    store.put("a", "2")
    store.delete("a")
    asked = spark.createDataFrame([("a",), ("b",)], "key string")
    assert pairs(pinned.snapshot()) == pairs(pinned.scan("a", "b")) == pairs(store.snapshot(n=n)) == [("a", "1")]
    assert value(pinned.get("a")) == value(store.get("a", n=n)) == value(pinned.multi_get(asked)) == "1"
    assert [r["version"] for r in pinned.history("a").collect()] == [1]
    assert pinned.stats().first()["entries"] == 1 and store.stats().first()["tombstones"] == 1
    assert pairs(store.snapshot()) == []
    # files that begin after the version are not opened
    assert len(store.begin_read().files(1)) == 1 < len(store.manifest().files)


def test_rollback(store):
    edits = store.begin_write()
    edits.insert("a", "1")
    edits.rollback()
    edits.insert("b", "2")
    assert edits.commit() == 1 and pairs(store.snapshot()) == [("b", "2")]


def test_bytes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/bytes", StoreConfig(binary=True))
    a, b = bytearray(b"\xff\x00a"), bytearray(b"\xff\x01")
    store.put(a, bytearray(b"\x80"))
    store.put(b, bytearray(b""))
    store.delete(b)
    assert [(bytes(r["key"]), bytes(r["value"])) for r in store.snapshot().collect()] == [(b"\xff\x00a", b"\x80")]
    assert bytes(store.get(a).first()["value"]) == b"\x80"
    assert [bytes(r["key"]) for r in store.scan(bytearray(b"\xff"), bytearray(b"\xff\x01")).collect()] == [bytes(a)]
    assert [bytes(r["key"]) for r in store.prefix_scan(bytearray(b"\xff\x00")).collect()] == [bytes(a)]
    assert [bytes(r["value"]) for r in store.history(b).collect()] == [b"", b""]


def test_compaction_of_a_range(store, spark):
    rows = [(f"k{k % 40}", k + 1, None if k % 7 == 0 else str(k), k % 7 == 0) for k in range(400)]
    store.load(spark.createDataFrame(rows, SCHEMA))
    want, files = pairs(store.snapshot(300)), len(store.manifest().files)
    assert files > 2
    middle = sorted(f["z_min"] for f in store.manifest().files)[files // 2]
    store.compact(300, (0, middle))
    tiers = store.tier_stats()
    assert tiers["cold"] and tiers["hot"] and tiers["total"] < 400
    assert pairs(store.snapshot(300)) == want


def test_compaction_keeps_what_came_meanwhile(store, spark, monkeypatch):
    store.put("a", "1")
    store.put("a", "2")
    write, done = store.write_segments, []

    def interrupted(rows, tier):
        files = write(rows, tier)
        if tier == "cold":
            done.append(1)
            store.put("b", "3")
        return files

    monkeypatch.setattr(store, "write_segments", interrupted)
    assert store.compact(2) == 1
    assert done == [1] and pairs(store.snapshot()) == [("a", "2"), ("b", "3")]
    assert store.tier_stats() == {"total": 2, "hot": 1, "warm": 0, "cold": 1}


def test_options(spark, tmp_path, capsys):
    assert cli.main(["--path", f"file://{tmp_path}/o", "--no-sync", "put", "k", "v"], spark) == 2
    assert cli.main(["--path", f"file://{tmp_path}/o", "--segment-size", "16", "put", "k", "v"], spark) == 0
    assert cli.main(["--path", f"file://{tmp_path}/o", "stats"], spark) == 0
    assert "entries 1" in capsys.readouterr().out
