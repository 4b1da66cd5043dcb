"""Command line: ``python -m tidemark.cli --path DIR get KEY [VERSION]`` and so on."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .sources.store import Store, StoreConfig


def _open(text: str) -> str | None:
    return None if text == "-" else text


def _number(text: str) -> int | None:
    return None if text == "-" else int(text)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description="A versioned key-value store on Spark.")
    out.add_argument("--path", default="./tidemark-data")
    out.add_argument("--max-records-per-file", type=int, default=1_000_000)
    out.add_argument("--segment-size", type=int, default=128, metavar="MB", help="bytes of a Parquet row group, in MB")
    out.add_argument("--sync", action=argparse.BooleanOptionalAction, default=True, help="commits are always durable; --no-sync is refused")
    out.add_argument("--cache-size", type=int, default=0, metavar="MB", help="0 only: segment files are cached by the system, not by the store")
    commands = out.add_subparsers(dest="command", required=True)
    for name, words in (
        ("get", ["key", "version?"]),
        ("put", ["key", "value"]),
        ("delete", ["key"]),
        ("scan", ["start?", "end?", "version?"]),
        ("history", ["key", "start?", "end?"]),
        ("snapshot", ["version?"]),
        ("compact", ["floor?"]),
        ("stats", []),
        ("benchmark", ["rows?"]),
        ("version", []),
    ):
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word.rstrip("?"), **({"nargs": "?", "default": "-"} if word.endswith("?") else {}))
    return out


def benchmark(store: Store, rows: int) -> None:
    made = store.spark.range(rows).select(F.format_string("key-%010d", "id").alias("key"), F.format_string("value-%0100d", "id").alias("value"))
    for name, work in (
        ("put", lambda: store.put_batch(made)),
        ("get", lambda: store.multi_get(made.select("key")).count()),
        ("scan", lambda: store.scan().count()),
    ):
        began = time.time()
        work()
        took = time.time() - began
        print(f"{name}: {rows} rows in {took:.2f} s ({rows / took:.0f} rows/s)")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "version":
        print(f"tidemark {__version__}")
        return 0
    if not a.sync or a.cache_size:
        print("every commit is durable, and the store keeps no cache: --no-sync and --cache-size have no meaning here")
        return 2
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = Store(spark, a.path, StoreConfig(max_records_per_file=a.max_records_per_file, block_bytes=a.segment_size << 20))
    if a.command == "get":
        found = store.get(a.key, _number(a.version)).collect()
        print(found[0]["value"] if found else "Key not found")
    elif a.command == "put":
        print(f"version {store.put(a.key, a.value)}")
    elif a.command == "delete":
        print(f"version {store.delete(a.key)}")
    elif a.command in ("scan", "snapshot"):
        bounds = (_open(a.start), _open(a.end)) if a.command == "scan" else (None, None)
        total = 0
        for row in store.scan(*bounds, _number(a.version)).orderBy("key").toLocalIterator():
            print(f"{row['key']}\t{row['value']}")
            total += 1
        print(f"{total} rows")
    elif a.command == "history":
        total = 0
        for row in store.history(a.key, _number(a.start), _number(a.end), tombstones=True).toLocalIterator():
            print(f"{row['version']}\t{'(deleted)' if row['deleted'] else row['value']}")
            total += 1
        print(f"{total} rows")
    elif a.command == "compact":
        print(f"{store.compact(_number(a.floor))} rows")
    elif a.command == "stats":
        row = store.stats().first().asDict()
        print(f"latest version {store.latest_version()}, tiers {store.tier_stats()}, " + ", ".join(f"{k} {v}" for k, v in row.items()))
    elif a.command == "benchmark":
        benchmark(store, _number(a.rows) or 100_000)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
