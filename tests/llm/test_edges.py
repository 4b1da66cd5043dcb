"""Columns that clash, and very long texts, for every operator that carries columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, lm, packing, quality, secrets, similar, simhash, token_counts, toxicity, url_filter

NAMES = ["row", "text", "held_out_", "bytes", "bits", "url_", "v", "fp", "label", "node", "first", "one", "word", "t"]
ADDED = {
    "lm": (lambda df, c: lm.score(df, F.lit(False), c), ["held_out", "n_tokens", "score", "bits_per_byte"]),
    "urls": (lambda df, c: url_filter.judge(df, carry=c), ["host", "path", "rule", "verdict", "p_block"]),
    "toxicity": (lambda df, c: toxicity.score(df, toxicity.train(df, df.select("doc_id", F.lit(0).alias("g")), F.col("g"), 2), c), ["grade", "toxic", "p_toxic", "expected_severity"]),
    "quality": (lambda df, c: quality.judge(df, c), ["n_words", "kept", "clean_text"]),
    "secrets": (lambda df, c: secrets.scan(df, c), ["spans"]),
    "histogram": (lambda df, c: token_counts.length_histogram(df, c), ["docs", "n_tokens"]),
    "decontamination": (lambda df, c: decontamination.decontaminate(df, df.sparkSession.createDataFrame([(1, "no such passage")], "item_id long, text string"), c), ["n_words", "hit_spans", "items", "n_hit"]),
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, f"some words of row {k} and a few more", f"http://a{k}.com/x") for k in range(4)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string").repartition(2)
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES if n != "text"})


@pytest.mark.parametrize("name", ADDED)
def test_carried_names(table, name):
    use, added = ADDED[name]
    carry = ("doc_id", "url", *NAMES)
    got = use(table, carry).select(*carry).collect()
    assert sorted(map(str, got)) == sorted(map(str, table.select(*carry).collect()))
    for bad in (*added, added[0].upper(), "__x"):
        with pytest.raises(ValueError):
            use(table.withColumn(bad, F.lit(1)), ("doc_id", bad))


def test_columns_that_pass_through(table):
    for drop in (simhash.drop_near_duplicates, similar.drop_similar):
        assert drop(table).columns == table.columns
        assert sorted(map(str, drop(table).collect())) == sorted(map(str, table.collect()))


def test_long_texts(spark):
    """A million words, a million blanks, one line of two million characters."""
    texts = ["word " * 1_000_000, " " * 1_000_000, "\n" * 1_000_000 + "end", "x" * 2_000_000, "ab12 " * 200_000 + "secret=" + "k9" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    judged = {r["doc_id"]: r for r in quality.judge(df, with_text=False).collect()}
    assert judged[0]["n_words"] == judged[0]["n_repeat_words"] == 1_000_000 and judged[2]["n_lines"] == 1_000_001
    item = spark.createDataFrame([(1, "word " * 10), (2, "x" * 2_000_000)], "item_id long, text string")
    hit = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.decontaminate(df, item).collect()}
    assert hit[0] == (1_000_000, ["1"]) and hit[3] == (1, ["2"]) and hit[1] == (0, [])
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in spans[4]] == [(1_000_000, 2_000_007, 0)]
    pieces = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces) and len(pieces) == 5
    scored = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") == 0).collect()}
    assert scored[0]["n_tokens"] == 1_000_001 and scored[0]["score"] < 0


def test_urls_long_and_repeated(spark):
    rows = [(k, "https://hot.com/a/b?x=1") for k in range(3000)] + [(5000, "http://" + "a." * 100_000 + "com/" + "p/" * 100_000), (5001, "https://" + "é" * 50_000)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 3002 and len({r["verdict"] for k, r in got.items() if k < 3000}) == 1
    assert got[5000]["host"] == "a." * 100_000 + "com" and got[5001]["path"] == ""
