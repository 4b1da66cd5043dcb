"""The pipeline's near-duplicates against a plain version."""

import random

import corpus_pipeline as P
import pytest
from tidemark.llm import similar

SCHEMA = "doc_id long, text string"


def plain(rows):
    """One id of each connected group of texts whose five-word sets are 4/5 alike."""
    sets = {}
    for k, text in rows:
        words = (text or "").lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {k: k for k in sets}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {find(k) for k in sets}


@pytest.mark.parametrize("few, most", [(16, 64), (2, 0)])
def test_similar(spark, few, most):
    r, rows = random.Random(3), [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "A  b")]
    vocabulary = [f"w{k}" for k in range(3000)]
    for k in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice((60, 150, 400)))]
        rows.append((10 * k, " ".join(base)))
        for j in range(1, 1 + r.choice((1, 2, 8))):
            own = list(base)
            for at in r.sample(range(len(own)), max(1, int(len(own) * r.choice((0.005, 0.01, 0.015, 0.02, 0.04))))):
                own[at] = r.choice(vocabulary)
            rows.append((10 * k + j, " ".join(own)))
    got = {x[0] for x in similar.drop_similar(spark.createDataFrame(rows, SCHEMA), few=few, most=most).collect()}
    assert got == plain(rows)


def test_pipeline_stage(spark):
    """Similarity 0.8 to 0.85, as the sixty-four bits do not see it."""
    r, rows = random.Random(5), []
    for k in range(30):
        base = [f"x{r.randrange(5000)}" for _ in range(104)]
        rows.append((2 * k, " ".join(base)))
        base[30], base[70] = "other", "others"
        rows.append((2 * k + 1, " ".join(base)))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {x[0] for x in P.near_duplicates(spark, docs, "").collect()} == plain(rows) == {2 * k for k in range(30)}


def test_stages_are_written(spark, tmp_path):
    """The last stage reads what the one before it wrote."""
    r = random.Random(8)
    docs = [(k, " ".join(r.choice("the of sea river mill old stone light".split()) for _ in range(60)) + ".", "en", "s", 1) for k in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage in here")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    files = P.run(spark, f"file://{tmp_path}").inputFiles()
    assert files and all("/secret-scan-" in f for f in files)


def test_fingerprints_bring_candidates(spark):
    """The operator's links of fingerprints are among the candidates: without bands, near copies are found by them alone."""
    from pyspark.sql import functions as F

    r, rows, want = random.Random(9), [], []
    for k in range(20):
        base = [f"y{r.randrange(9000)}" for _ in range(600)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join([*base[:300], "other", *base[301:]])))
    sets = {k: similar.shingles(x) for k, x in rows}
    fps = {k: similar.simhash.majority(x) for k, x in sets.items()}
    want = {(a, b) for a in sets for b in sets if a < b and (fps[a] ^ fps[b]).bit_count() <= 4 and similar.alike(sets[a], sets[b])}
    assert len(want) >= 10
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(k, len(sets[k]), signed(fps[k]), similar.parity(sets[k]).tolist(), [k]) for k in sets], "node long, size long, fp long, parity array<long>, bands array<long>")
    texts = spark.createDataFrame(rows, "node long, text string")
    found = {(x["a"], x["b"]) for x in similar.links(nodes, texts).select(F.col("a"), F.col("b")).collect()}
    assert found == want


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_single_texts_are_not_shuffled(spark):
    """Only texts that pairs name, and rows that may be copies, are moved, however many rounds there are."""
    r = random.Random(4)
    rows = [(k, " ".join(f"{r.getrandbits(64):x}" for _ in range(1500))) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(6)] + [(2000 + k, rows[k][1]) for k in range(6)]
    docs, before = spark.createDataFrame(rows, SCHEMA), shuffled(spark)
    got = [x[0] for x in similar.drop_similar(docs, few=1, most=0).collect()]
    assert sorted(got) == sorted(k for k, _ in rows if k < 1000)
    assert shuffled(spark) - before < 0.5 * sum(len(x) for _, x in rows)


@pytest.mark.parametrize("n", [0, 1, 3000, 1 << 17])
def test_marks_lose_no_key(spark, n, monkeypatch):
    from pyspark.sql import functions as F
    from tidemark.llm import _common

    monkeypatch.setattr(_common, "MARK_BITS", 17)
    keys = spark.range(0, 7 * n, 7).toDF("k")
    found = _common.marked(spark.range(max(1, 8 * n)).toDF("node"), "node", _common.marks(keys, n))
    inside = (F.col("node") % 7 == 0) & (F.col("node") < 7 * n)
    kept, lost, others = found.agg(F.count("*"), F.count_if(inside & ~F.col("__marked")), F.count_if(~inside & F.col("__marked"))).first()
    assert kept == max(1, 8 * n) and lost == 0
    assert others <= (0.1 * 7 * n if n <= 3000 else 7 * n)
