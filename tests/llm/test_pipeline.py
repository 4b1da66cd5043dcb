"""The pipeline: what each stage keeps, and that all queries are registered."""

import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline as P
from tidemark.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    words = [f"{a}{b}" for a in "the of sea river mill old stone light road day".split() for b in ("", "s", "en", "ly", "ing")]
    return " ".join(r.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, at = random.Random(1), tmp_path_factory.mktemp("tables")
    texts = [prose(r, 80) for _ in range(12)]
    leak = prose(r, 30)
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100, texts[3]), (101, texts[3]), (102, prose(r, 20) + " " + leak + " " + prose(r, 20)), (103, None), (104, ""), (105, "too short")]
    rows += [(106, prose(r, 40) + " password = hunter2hunter2 " + prose(r, 40)), (107, "Home | About | Login | Help\n" * 12), (108, prose(r, 60) + "\nHome | About | Login | Help\n" + prose(r, 60))]
    table = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    table.write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    good = {*range(12), 100, 101, 102, 106, 108}
    assert set(seen["quality rules"]) == good
    assert "Home" not in seen["quality rules"][108]
    assert set(seen["near-duplicates"]) == good - {100, 101}
    assert set(seen["benchmark decontamination"]) == good - {100, 101, 102}
    assert "hunter2" not in seen["secret scan"][106] and "[SECRET]" in seen["secret scan"][106]
    out = P.run(spark, folder).collect()
    assert {x["doc_id"] for x in out} == good - {100, 101, 102}
    assert all(len(np.frombuffer(bytes(x["ids"]), dtype="<u4")) == x["length"] for x in out)


def test_empty_and_further_columns(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumn("kept", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("fp", F.lit(2)).withColumn("n_hit", F.lit(3))
    none = docs.limit(0)
    for _, stage in P.STAGES:
        wide, none = stage(spark, wide, folder), stage(spark, none, folder)
    assert wide.count() > 0 and none.count() == 0


def test_text_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*SCHEMA.split()[2:3])
    for _, stage in P.STAGES[:1] + P.STAGES[2:-1]:
        docs = stage(spark, docs, folder)
    assert docs.columns == ["text"] and docs.count() > 0


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert "pipeline" in known
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in known) == 1
    assert set(queries.oracle_sql()) <= set(queries.queries())
