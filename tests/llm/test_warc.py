"""WARC archives: an exact round trip, skipping, pushed filters, lost attempts."""

import hashlib

import pytest

from tidemark.llm import warc

PAGES = [
    (5, "http://a/5", "<p>" + "x" * 200),
    (2, "http://a/2", "<p>" + "x" * 200),
    (9, "http://a/9\r\nEvil: yes", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (1, None, None),
    (3, "http://a/3", "short"),
    (4, "http://a/4", "short"),
    (6, "http://a/6", "é😀" * 5000),
    (2, "http://a/2", "<p>" + "x" * 200),
    (None, "http://a/n", "<p>" + "x" * 200),
    (None, "http://a/n", "n" * 300),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def want():
    first = {}
    for k, _, h in PAGES:
        if k is not None and h and len(h.encode()) >= 100:
            first[h] = min(k, first.get(h, k))
    for k, _, h in PAGES:
        again = h in first and first[h] != k
        yield str(k) if k is not None else None, "revisit" if again else "response", f"<urn:page:{first[h]}:" if again else None, h or ""


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/{compression}"
    warc.write(pages, path, compression)
    got = warc.read(spark, path)
    have = [
        (r["page_key"], r["record_type"], r["refers_to"] and r["refers_to"].rpartition(":")[0] + ":", r["payload_length"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got.collect()
    ]
    wanted = [
        (k, t, f, len(h.encode()), "sha256:" + hashlib.sha256(h.encode()).hexdigest(), h.encode() if t == "response" else None) for k, t, f, h in want()
    ]
    assert sorted(have, key=str) == sorted(wanted, key=str)
    ids = {r["record_id"]: r for r in got.collect()}
    assert len(ids) == len(PAGES)
    assert all(ids[r["refers_to"]]["record_type"] == "response" and ids[r["refers_to"]]["payload_digest"] == r["payload_digest"] for r in ids.values() if r["refers_to"])
    only = warc.read(spark, path).filter("record_type = 'revisit'")
    assert only.count() == sum(1 for _, t, _, _ in want() if t == "revisit")
    light = warc.read(spark, path, columns=("record_type", "page_key")).collect()
    assert len(light) == len(PAGES) and all(r["payload"] is None and r["record_id"] is None for r in light)


def test_small_ranges_read_each_record_once(spark, pages, tmp_path):
    path = f"file://{tmp_path}/split"
    warc.write(pages.coalesce(1), path, "none")
    warc.register(spark)
    got = spark.read.format("warc").option("split", "700").load(path)
    assert sorted(r["page_key"] or "" for r in got.select("page_key").collect()) == sorted(str(k) if k is not None else "" for k, _, _ in PAGES)


def test_lost_attempts_are_not_read(spark, pages, tmp_path):
    path = f"file://{tmp_path}/lost"
    warc.write(pages, path, "none")
    (tmp_path / "lost" / "part-dead.warc").write_bytes(warc.record_bytes({"record_type": "response", "payload": b"x", "page_key": "77"}, warc.now()))
    assert warc.read(spark, path).filter("page_key = '77'").count() == 0


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(none, f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_commits_do_not_undo_each_other(spark, pages, tmp_path):
    path = f"file://{tmp_path}/two"
    first, second = (warc.WarcWriter({"path": path, "date": "2020-01-02T03:04:05Z"}, False) for _ in range(2))
    rows = [spark.createDataFrame([(f"<urn:x:{k}>", "response", str(k), b"x" * 10)], "record_id string, record_type string, page_key string, payload binary").first() for k in range(2)]
    done = [w.write(iter([r])) for w, r in ((first, rows[0]), (second, rows[1]))]
    first.commit(done[:1])
    second.commit(done[1:])
    assert sorted(r["page_key"] for r in warc.read(spark, path).select("page_key").collect()) == ["0", "1"]
    text = b"".join(f.read_bytes() for f in (tmp_path / "two").glob("*.warc")).decode()
    assert text.count("WARC-Date: 2020-01-02T03:04:05Z\r\n") == 2
    again = warc.WarcWriter({"path": path}, True)
    again.commit([again.write(iter(rows[:1]))])
    assert [r["page_key"] for r in warc.read(spark, path).select("page_key").collect()] == ["0"]
