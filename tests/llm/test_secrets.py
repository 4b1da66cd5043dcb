"""Secret scans: the battery and the false-discovery procedure against a plain version, tails, and many matches."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemark.llm import secrets

ENGLISH = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))


def below(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def plain_battery(token):
    """Encoding, band, step and the battery's p-value."""
    body = token.rstrip("=")
    encoding = next(k for k, e in enumerate(secrets.ENCODINGS) if re.search(e[1], body))
    _, _, letters, agree = secrets.ENCODINGS[encoding]
    n, size = len(body), len(letters)
    squares = sum(body.count(c) ** 2 for c in letters)
    df = size - 1
    chi = squares * size / n - n
    z_chi = (max(chi / df, 0) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    ranks = [letters.find(c) + 1 for c in body]
    middle, mean = (size + 1) / 2, sum(ranks) / n
    high = sum(r > middle for r in ranks)
    runs = 1 + sum((a > middle) != (b > middle) for a, b in zip(ranks, ranks[1:], strict=False))
    both = 2 * high * (n - high)
    z_runs = (runs - (both / n + 1)) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9))
    spread = sum((r - mean) ** 2 for r in ranks)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(ranks, ranks[1:], strict=False))
    z_serial = (lagged / max(spread, 1e-9) + 1 / n) * math.sqrt(n)
    p = min(3 * min(below(-z_chi), 2 * below(-abs(z_runs)), 2 * below(-abs(z_serial))), 1)
    share = (squares - n) / (n * (n - 1))
    wide = 2 * agree * (1 - agree) / (n * (n - 1)) + 4 * (n - 2) * (secrets.THREE - 1) * agree**2 / (n * (n - 1))
    strength = -math.log10(max(below((share - agree) / math.sqrt(wide)), 1e-30))
    return encoding, math.floor(math.log2(n) * 2), min(math.floor(strength * 10), secrets.STEPS), p


def plain_random(texts, false_share=secrets.FALSE_SHARE, level=secrets.BATTERY_LEVEL):
    mixed = re.compile("[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]|^[a-z]+$|^[A-Z]+$")
    found = []
    for k, text in enumerate(texts):
        for m in re.finditer("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", text):
            if mixed.search(m[0]) and len(m[0].rstrip("=")) > 2:
                found.append((k, m.start(), m.end(), *plain_battery(m[0])))
    strata = {}
    for *_, encoding, band, step, _ in found:
        strata.setdefault((encoding, band), Counter())[step] += 1
    cuts = {}
    for stratum, counts in strata.items():
        above = 0
        for step in sorted(counts, reverse=True):
            above += counts[step]
            if 10 ** (-step / 10) * sum(counts.values()) <= false_share * above:
                cuts[stratum] = step
    return {(k, a, b) for k, a, b, encoding, band, step, p in found if step >= cuts.get((encoding, band), 1000) and p >= level}


def ordinary(r, n):
    return "".join(r.choices(list(ENGLISH), list(ENGLISH.values()), k=n))


@pytest.mark.parametrize("seed", [1, 2])
def test_battery_and_discovery_procedure(spark, seed):
    r = random.Random(seed)
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = [ordinary(r, r.randrange(20, 90)) for _ in range(120)]
    tokens += ["".join(r.choice(a) for _ in range(r.randrange(24, 120))) for a in (wide, wide + "+/", wide[:26] + "234567", wide[26:52]) for _ in range(12)]
    tokens += ["some/long/path/of/many/things/2024", "CamelCaseIdentifierNameFactoryBean", "a" * 30, "ab" * 20, "x=" * 15, "aB3=" + "=" * 30]
    r.shuffle(tokens)
    texts = [" ".join(tokens[k : k + 3]) for k in range(0, len(tokens), 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], s["start"], s["end"]) for x in secrets.scan(df).collect() for s in x["spans"] if s["kind"] == 3}
    want = {x for x in plain_random(texts) if not any(a < x[2] and x[1] < b for a, b in plain_base_spans(texts[x[0]]))}
    assert got == want and want


def plain_base_spans(text):
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    return [m.span() for m in assign.finditer(text) if len(m[1]) >= 6] + [m.span() for p in ("AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}") for m in re.finditer(p, text)]


def test_tails(spark):
    zs = [x / 4 for x in range(-44, 45)]
    got = [x[0] for x in spark.createDataFrame([(z,) for z in zs], "z double").select(secrets._below(F.col("z"))).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p == pytest.approx(below(z), rel=1e-5), z


def test_few_ordinary_tokens_are_reported(spark):
    """4,000 tokens of English letters without a secret among them, and the same with 100 random ones of 95."""
    r = random.Random(9)
    clean = [ordinary(r, r.randrange(20, 100)) for _ in range(4000)]
    scan = lambda rows: {x["doc_id"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if x["spans"]}
    rows = list(enumerate(clean))
    assert len(scan(rows)) <= 5
    keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(95)) for _ in range(100)]
    found = scan(rows + [(50_000 + k, x) for k, x in enumerate(keys)])
    assert sum(k < 50_000 for k in found) <= max(5, 0.05 * len(found))


def test_many_matches(spark):
    """Forty thousand matches of one text, and a redaction of as many."""
    n = 40_000
    text = " ".join(f"token=abc{k:06d}" for k in range(n)) + " 😀 end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = secrets.scan(df, carry=("doc_id", "text"))
    row = found.select("spans", secrets.redact(F.col("text"), F.col("spans"), "#").alias("out")).first()
    assert [(s["start"], s["end"], s["kind"]) for s in row["spans"]] == [(16 * k, 16 * k + 15, 0) for k in range(n)]
    assert row["out"] == " ".join("#" * n) + " 😀 end"
    assert time.time() - began < 120
