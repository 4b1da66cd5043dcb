"""The verbs against a plain model on random changelogs, and Z order against its Python twins."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import zorder as Z
from tidemark.operators import compaction, reads, tiers, writes
from tidemark.plans import zfilters
from tidemark.sources.changelog import SCHEMA, open_log

KEYS = ["", "a", "ab", "abc", "user:1", "user:10", "user:2", "é", "z"]


def random_log(seed, n=300):
    r = random.Random(seed)
    rows = []
    for v in range(1, n + 1):
        dead = r.random() < 0.25
        rows.append((r.choice(KEYS), v, None if dead else r.choice(["", "x", f"v{v}"]), dead))
    r.shuffle(rows)
    return rows


def model(rows, version=None, start=None, end=None):
    best = {}
    for k, v, value, dead in rows:
        if v > 0 and (version is None or v <= version) and v > best.get(k, (0,))[0]:
            best[k] = (v, value, dead)
    raw = lambda k: k.encode()
    return {k: b[1] for k, b in best.items() if not b[2] and (start is None or raw(k) >= raw(start)) and (end is None or raw(k) < raw(end))}


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark):
    rows = random_log(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("version", [0, 1, 57, 300, 9999, None])
def test_snapshot_and_get(both, version):
    rows, log = both
    want = model(rows, version)
    assert as_dict(reads.snapshot(log, version)) == want
    for k in ("user:1", "", "missing"):
        assert as_dict(reads.get_as_of(log, k, version)) == ({k: want[k]} if k in want else {})


@pytest.mark.parametrize("bounds", [(None, None), ("user:1", "user:2"), (None, "b"), ("b", None), ("z", "a"), ("é", None)])
def test_scan(both, bounds):
    rows, log = both
    assert as_dict(reads.scan_as_of(log, *bounds, 200)) == model(rows, 200, *bounds)
    assert reads.scan_count(log, *bounds, 200).first()[0] == len(model(rows, 200, *bounds))


def test_history_shows_tombstones_as_empty(both):
    rows, log = both
    want = sorted((v, "" if d else x, d) for k, v, x, d in rows if k == "ab" and 10 <= v <= 250)
    assert [tuple(r) for r in reads.history(log, "ab", 10, 250, tombstones=True).collect()] == want


def test_multi_get_and_tiers(both, spark):
    rows, log = both
    asked = spark.createDataFrame([("ab",), ("z",), ("nobody",)], "key string")
    assert as_dict(reads.multi_get(log, asked, 222)) == {k: v for k, v in model(rows, 222).items() if k in ("ab", "z")}
    parts = [log.filter("version > 100"), log.filter("version <= 100")]
    assert as_dict(tiers.tier_scan(parts, None, None, 90)) == model(rows, 90)


@pytest.mark.parametrize("floor", [0, 1, 150, 300])
def test_compaction_keeps_reads_from_the_floor(both, floor):
    rows, log = both
    small = compaction.compact_latest(log, floor)
    for version in (max(floor, 1), 260, 300):
        if version >= floor:
            assert as_dict(reads.snapshot(small, version)) == model(rows, version)


def test_as_of_join_and_diff(both, spark):
    rows, log = both
    probes = spark.createDataFrame([(i, KEYS[i % len(KEYS)], i * 7 % 320) for i in range(60)], "probe_id long, key string, at long")
    for r in reads.as_of_join(probes, log).collect():
        assert r["value"] == model(rows, r["at"]).get(r["key"])
    old, new = model(rows, 50), model(rows, 280)
    got = {r["key"]: r["change"] for r in reads.snapshot_diff(log, 50, 280).collect()}
    want = {k: "added" if k not in old else "removed" if k not in new else "changed" for k in {*old, *new} if old.get(k, 0) != new.get(k, 0)}
    assert got == want


def test_empty_log(spark):
    log = open_log(spark)
    assert reads.snapshot(log).count() == 0
    assert reads.latest_version(log).first()[0] == 0
    assert reads.next_version(log).first()[0] == 1
    assert compaction.compact_latest(log, 5).count() == 0


def test_numbering_is_dense_and_in_order(spark):
    rows = [(f"k{i:04d}", str(i)) for i in range(1000)]
    random.Random(4).shuffle(rows)
    out = writes.put_rows(spark.createDataFrame(rows, "key string, value string").repartition(7), 10).collect()
    assert sorted((r["version"], r["key"]) for r in out) == [(11 + i, f"k{i:04d}") for i in range(1000)]
    assert writes.put_rows(spark.createDataFrame([], "key string, value string"), 3).count() == 0


@pytest.fixture
def many_partitions(spark):
    """Range partitions that adaptive execution deals by their bytes, so other columns give other partitions."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_numbering_of_a_wide_batch(spark, many_partitions):
    n = 60_000
    value = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256)))
    puts = spark.range(0, n, 1, 8).select(F.format_string("k%06d", (F.col("id") * 7919) % n).alias("key"), value.alias("value"))
    rows = writes.put_rows(puts, 5)
    rows.write.mode("overwrite").format("noop").save()
    seen = rows.select("key", "version", F.length("value").alias("size")).collect()
    assert sorted((r["version"], r["key"]) for r in seen) == [(6 + i, f"k{i:06d}") for i in range(n)]
    assert {r["size"] for r in seen} == {1024}
    gone = writes.delete_rows(puts.withColumn("key", F.concat("key", "value")), 0).select("version").distinct().count()
    assert gone == n


def plain_adjacent(rows):
    """Runs of one hash, within a bucket and in order of z, keep their newest version."""
    out, last = [], None
    for bucket, z, version, key_hash in sorted(rows):
        if last == (bucket, key_hash):
            out[-1] = max(out[-1], version)
        else:
            out.append(version)
        last = (bucket, key_hash)
    return sorted(out)


@pytest.mark.parametrize("hashes", [2, 40, 3000])
def test_adjacent_runs_go_on_over_ranges(spark, many_partitions, hashes):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(hashes)
    rows = [(k // 1000, k, v, r.randrange(hashes) if k % 50 else 7) for k, v in zip(range(4000), r.sample(range(10_000), 4000), strict=True)]
    rows += [(9, 5000 + k, 20_000 - k, 1) for k in range(3000)]
    log = spark.createDataFrame(rows, "bucket long, z long, version long, key_hash long").repartition(5)
    try:
        assert sorted(r[0] for r in compaction.compact_adjacent(log).select("version").collect()) == plain_adjacent(rows)
        assert compaction.compact_adjacent(log.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@given(st.lists(st.tuples(st.text(max_size=8), st.integers(0, 2**31 - 1)), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_z_order_equals_python(spark, pairs):
    df = spark.createDataFrame(pairs, "key string, version long").select(
        "key", "version", Z.key_hash_le4(F.col("key")).alias("l"), Z.key_hash_fnv(F.col("key")).alias("f"), Z.key_hash_fnv_low(F.col("key")).alias("h")
    )
    z = Z.z_encode(F.col("h"), F.col("version"))
    for r in df.select("*", z.alias("z"), Z.z_key_hash(z).alias("zh"), Z.z_version(z).alias("zv"), Z.z_bucket(z).alias("b")).collect():
        fnv = Z.py_fnv(r["key"])
        assert r["l"] == Z.py_le4(r["key"])
        assert (r["f"]["high"] << 32 | r["f"]["low"]) == fnv
        assert r["z"] == Z.py_z(fnv & Z.MASK, r["version"]) >= 0
        assert (r["zh"], r["zv"]) == (fnv & Z.MASK, r["version"])
        assert r["b"] == min(r["z"] // Z.bucket_width(), 3)


def test_worker_ranges_cover_everything():
    ranges = zfilters.worker_ranges(4)
    assert ranges[0][0] == 0 and ranges[-1][1] == 2**64 - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


@given(st.integers(0, 255), st.integers(0, 255), st.integers(0, 255), st.integers(0, 255))
@settings(max_examples=40, deadline=None)
def test_split_box_covers_the_box(a, b, c, d):
    h, v = sorted((a, b)), sorted((c, d))
    spans = zfilters.split_box(*h, *v)
    assert len(spans) <= 20
    for x in (h[0], sum(h) // 2, h[1]):
        for y in (v[0], sum(v) // 2, v[1]):
            assert any(low <= Z.py_z(x, y) <= high for low, high in spans)


def test_shape_of_plans(spark):
    """A point read pushes its filters to the files and shuffles nothing but the top row."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    from tidemark.sources.changelog import orders_log

    plan = reads.get_as_of(orders_log(spark, "/root/testdata/sf0.001"), "cust:1", 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
