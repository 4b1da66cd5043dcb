"""The toxicity model's counts: labels go to the documents, not texts to the labels."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def tables(spark):
    rows = [(k % 70, f"plain words {'nasty vile' if k % 5 == 0 else 'mild'} w{k % 9}") for k in range(80)] + [(None, "nasty"), (500, None)]
    labels = [(k, int(k % 5 == 0)) for k in range(0, 75)] + [(5, 1)] * 30 + [(5, 0), (7, None), (None, 1), (500, 0)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_no_text_is_shuffled(spark):
    _, _, docs, labels = tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = toxicity.feature_counts(docs.coalesce(3).select(F.col("doc_id").alias("id"), "text"), labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("grade"), F.lit(1).alias("times")))
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_counts_and_blocks(spark, monkeypatch):
    rows, labels, docs, graded = tables(spark)
    want = Counter()
    for d, grade in labels:
        for own, text in rows:
            if d is not None and grade is not None and own == d:
                for f in (*toxicity.features_of(text or ""), ""):
                    want[f] += 1
    found, plain = {}, toxicity.feature_counts

    def spied(texts, labelled):
        out = plain(texts, labelled)
        for r in out.collect():
            found[r["feature"]] = found.get(r["feature"], 0) + r["all"]
        return out

    monkeypatch.setattr(toxicity, "feature_counts", spied)
    one = toxicity.train(docs, graded, F.col("toxic"), 2)
    assert found == dict(want)
    found.clear()
    many = toxicity.train(docs, graded, F.col("toxic"), 2, block=20)
    assert found == dict(want)
    assert one.names == many.names and np.array_equal(one.weights, many.weights) and np.array_equal(one.thresholds, many.thresholds)
