"""Counts behind fitted models cover all labelled rows, not only those fitted on."""

import random

from pyspark.sql import functions as F
from tidemark.llm import toxicity, url_filter


def test_toxic_stems_beyond_the_sample(spark):
    r, stems = random.Random(4), [f"{a}{a}{a}{b}{b}" for a in "bdfgk" for b in "xz"]
    rows = [(k, f"plain words {r.choice('abc')} " + (stems[k % 10] if k % 2 == 0 else ""), k % 2 == 0) for k in range(1200)]
    rows = [(k, f"plain words {stems[k // 2 % 10]}" if toxic else text, toxic) for k, text, toxic in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("toxic"), 2, sample=30)
    assert set(stems) <= set(model.names)


def test_features_grow(spark):
    rows = [(k, " ".join(f"{a}{'hijklmno'[k // 2 % 8]}q{a * 2}" for a in "abcdefghijklmnopqrst") if k % 2 else "plain words", k % 2) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("toxic"), 2)
    words = {w for _, text, toxic in rows if toxic for w in text.split()}
    assert len(words) == 160 and words <= set(model.names) and len(model.names) > 512


def test_rare_suffixes_beyond_the_sample(spark):
    rows = [(f"https://h{k}.{'rare' if k % 20 == 0 else 'com'}/p/{k}", f"h{k}.{'rare' if k % 20 == 0 else 'com'}", f"/p/{k}", k % 20 == 0) for k in range(1000)]
    _, odds = url_filter.train(spark.createDataFrame(rows, "url string, host string, path string, blocked boolean"), 100)
    assert odds[0]["rare"] > 0 > odds[0]["com"] and set(odds[2]) == {"p"}


def test_copies_of_a_hot_url_are_sampled_apart(spark):
    rows = [(k, "https://hot.com/a" if k % 3 == 0 else f"https://h{k}.com/a") for k in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    seen = []
    old = url_filter.fit
    url_filter.fit = lambda x, y: seen.append(x) or old(x, y)
    try:
        url_filter.judge(df, df.withColumn("blocked", F.col("page_id") % 2 == 0), rules=(), sample=300).count()
    finally:
        url_filter.fit = old
    hot = (seen[0][:, 0] == len("https://hot.com/a")).sum() / len(seen[0])
    assert len(seen[0]) == 300 and 0.2 < hot < 0.5


def test_toxicity_edges(spark):
    """Empty tables, repeated documents and labels, long texts, null ids, and names that clash."""
    import pytest

    rows = [(k, "plain words " * 5 + ("scum idiot" if k % 2 else "fine day"), k % 2, k % 4 // 2) for k in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1, "plain scum idiot")] * 300 + [(None, None), (900, "long fine words " * 60_000), (901, "scum idiot " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t, q) for k, _, t, q in rows] + [(1, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    grade = toxicity.severity(F.col("toxic"), F.col("quality"))
    got = [tuple(x) for x in labels.select("toxic", "quality", grade.alias("g")).distinct().collect()]
    assert set(got) == {(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 0, 2), (None, None, None)}
    model = toxicity.train(docs, labels, grade, 3, sample=150)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 503 and all(x["toxic"] == (x["grade"] > 0) for x in out)
    toxic = {x["doc_id"]: x["toxic"] for x in out}
    assert toxic[901] and not toxic[900] and all(toxic[k] == bool(k % 2) for k in range(200))
    none = toxicity.train(docs.limit(0), labels, grade, 3)
    assert toxicity.score(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("grade", F.lit(1)), model, ("doc_id", "grade"))


def test_fit_is_the_least(spark):
    """Against the numeric gradient of the likelihood, written out plainly."""
    import numpy as np

    r = random.Random(1)
    x = np.array([[r.random() < 0.3 for _ in range(6)] for _ in range(300)], dtype=float)
    true = np.array([2.0, -1.0, 0.5, 0.0, 1.0, -0.5])
    grades = np.array([sum(s > t for t in (0.4, 1.6)) for s in x @ true + np.array([r.gauss(0, 1) for _ in range(300)])])
    at, of = np.nonzero(x)
    w, t = toxicity.fit_ordinal(at, of, 6, grades, 3)

    def loss(w, t):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        full = np.concatenate((np.ones((300, 1)), above, np.zeros((300, 1))), axis=1)
        return -np.log(full[range(300), grades] - full[range(300), grades + 1]).mean() + toxicity.RIDGE / 2 * (w @ w)

    best = loss(w, t)
    for k in range(6):
        for step in (0.02, -0.02):
            assert loss(w + step * np.eye(6)[k], t) > best
    for step in (0.02, -0.02):
        assert loss(w, t + step) > best - 1e-5
