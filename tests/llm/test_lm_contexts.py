"""The language model's contexts: the second word before, passages in growing tables, and predictions that follow every step."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import lm, lm_passages


def test_second_word_before():
    """What the second word before tells is a context of its own, whatever word is between."""
    r = random.Random(2)
    words = [(f"w{k}".encode(), 5) for k in range(40)]
    codes = lm.Codes.build(words, 200, 16, 1)
    texts = lm.Texts.of([f"w1 w{k} w2" for k in r.sample(range(3, 40), 2)], codes)
    slots, _, _, starts, _, _ = next(lm.bits_of(texts, codes))
    assert len(slots) == 4
    ends = [*starts[1:].tolist(), len(slots[0])]
    third = [slice(starts[k], ends[k]) for k in (2, 6)]
    assert (slots[3][third[0]] == slots[3][third[1]]).all()
    assert not (slots[2][third[0]] == slots[2][third[1]]).all()


@pytest.mark.parametrize("bits", [10, 14])
def test_predictions_follow_every_step(bits):
    codes = lm.Codes.build([(b"a", 9), (b"b", 7), (b"c", 2)], 20, bits, 3)
    learner = lm.Learner(codes)
    for text in ("a b a c", "a a b zz" * 40, "c b", "a"):
        learner.learn(lm.Texts.of([text], codes))
        assert np.array_equal(learner.evident, lm.evidence(*learner._tables()))


def plain_passages(words, every):
    """By a text's hashes: (first, last, words of the context, words of the passage)."""
    with np.errstate(over="ignore"):
        def context(own):
            out = lm_passages.mix(np.array([own[0]], dtype=np.uint64) + lm_passages._C)
            for w in own[1:]:
                out = lm_passages.mix(out + np.uint64(w) * lm_passages._A)
            return int(out[0])

        at = [k for k in range(3, len(words)) if context(words[k - 3 : k]) % every == 0]
    return [(a, b, tuple(words[a - 3 : a]), tuple(words[a:b])) for a, b in zip(at, [*at[1:], len(words)], strict=False)]


@pytest.mark.parametrize("every", [1, 4])
def test_passages(every):
    r = random.Random(every)
    texts = [[r.choice((5, 7, 2**63, 2**64 - 1)) for _ in range(r.randrange(0, 25))] for _ in range(30)]
    hashes = np.array([w for t in texts for w in t], dtype=np.uint64)
    owner = np.repeat(np.arange(30), [len(t) for t in texts])
    first, last, context, whole = lm_passages.passages(hashes, owner, every)
    starts = np.cumsum([0, *map(len, texts)])
    want = [(a + starts[k], b + starts[k], c, p) for k, t in enumerate(texts) for a, b, c, p in plain_passages(t, every)]
    assert [(a, b) for a, b, *_ in want] == list(zip(first.tolist(), last.tolist(), strict=True))
    assert len({c for *_, c, _ in want}) == len(set(context.tolist())) == len(set(zip((c for *_, c, _ in want), context.tolist(), strict=True)))
    assert len({p for *_, p in want}) == len(set(whole.tolist())) == len(set(zip((p for *_, p in want), whole.tolist(), strict=True)))
    text, c, p, times, bits = lm_passages.by_document(owner[first], context, whole, np.ones(len(first)))
    assert Counter(zip(owner[first].tolist(), context.tolist(), whole.tolist(), strict=True)) == {x[:3]: x[3] for x in zip(text.tolist(), c.tolist(), p.tolist(), times.tolist(), strict=True)}
    assert (bits == times).all() and (np.diff(text) >= 0).all()
    assert all(len(x) == 0 for x in lm_passages.passages(hashes[:2], owner[:2]))


def level(count):
    return sum(count >= k for k in lm_passages.LEVELS)


def test_passages_are_coded_without_their_document(spark):
    r = random.Random(6)
    rows = {}
    for row in range(60):
        for _ in range(6):
            rows[row, r.randrange(8), r.randrange(4) if r.random() < 0.8 else 100 + row] = (r.randrange(1, 3), r.random() * 50)
    held = {k: k % 4 == 0 for k in range(60)}
    table = [(row, held[row], c, p, n, b) for (row, c, p), (n, b) in rows.items()]
    df = spark.createDataFrame(table, "row long, held boolean, context long, passage long, times long, bits double").repartition(3)
    got = {x["row"]: x["bits"] for x in lm_passages.coded(df).collect()}
    cells, tally = [], Counter()
    for row, out, c, p, n, b in table:
        counts = Counter()
        for other, gone, c2, p2, n2, _ in table:
            if c2 == c and not gone and not (other == row and p2 == p):
                counts[p2] += n2
        everyone = Counter()
        for _, gone, c2, p2, n2, _ in table:
            if c2 == c and not gone:
                everyone[p2] += n2
        # the two that lead with the document in; of equal counts the smaller number
        top = sorted(everyone, key=lambda x: (-everyone[x], x))[:2]
        left = [counts[x] if x == p else everyone[x] for x in top] + [0]
        if not top or max(left) <= 0:
            continue
        lead = 0 if left[0] >= left[1] else 1
        cell = (level(left[lead]), level(left[1 - lead]), top[lead] == p)
        cells.append((row, cell, n, b))
        if not out:
            tally[cell] += n
    want = Counter()
    for row, (a, b, hit), n, bits in cells:
        hits, miss = tally[a, b, True], tally[a, b, False]
        chance = (hits + 0.4) / (hits + miss + 0.8)
        want[row] += n * -math.log2(chance if hit else 1 - chance) - (bits if hit else 0)
    assert got.keys() == want.keys()
    for k, x in got.items():
        assert x == pytest.approx(want[k], abs=1e-9)
    assert lm_passages.coded(df.limit(0)).count() == 0


def test_a_copy_elsewhere_tells(spark):
    """Documents that occur twice are scored apart from those that occur once, at any size of the corpus."""
    r = random.Random(4)
    texts = [" ".join(f"v{r.randrange(500)}" for _ in range(150)) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["bits_per_byte"] for x in lm.score(df, F.col("doc_id") % 7 == 2).collect()}
    # the other copy was learned from
    twice = [got[k] for k in range(40) if (1000 + k) % 7 != 2]
    once = sorted(got[k] for k in range(40, 400))
    assert sum(x < once[0] for x in twice) == len(twice)
    assert abs(np.mean([got[k] for k in range(40, 400) if k % 7 == 2]) - np.mean([got[k] for k in range(40, 400) if k % 7 != 2])) < 0.05 * np.mean(once)


def test_carried_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2.0), (2, None, None, None)], "doc_id long, text string, bits string, row double")
    got = lm.score(df, F.lit(False), ("doc_id", "text", "bits", "row")).collect()
    assert {(x["doc_id"], x["text"], x["bits"], x["row"], x["n_tokens"]) for x in got} == {(1, "a b", "x", 2.0, 3), (2, None, None, None, 1)}
    with pytest.raises(ValueError):
        lm.score(df.withColumn("score", F.lit(1)), F.lit(False), ("doc_id", "score"))


def test_mix_in_steps():
    """The final map's chances of both bits add up to one, and slices cut texts anywhere."""
    model = lm.Model.of(np.zeros((4, 1 << 14)), np.zeros((4, 1 << 14)), lm.first_weights(), np.zeros((lm.MAP_SETS, lm.MAP_STEPS)), np.zeros((lm.MAP_SETS, lm.MAP_STEPS)))
    final = model.final.reshape(lm.MAP_SETS, 2, lm.WAYS)
    assert np.allclose(final.sum(axis=1), 1, atol=1e-6) and (final > 0).all()
    assert math.isclose(float(lm._CHANCE[lm.MIX_STEPS * lm.MIX_MOST]), 0.5)
    codes = lm.Codes.build([(b"a", 9), (b"b", 7), (b"c", 2)], 20, 14, 3)
    texts = lm.Texts.of(["a b zz zzz", "", "c yy a"], codes)
    whole, before = lm.costs(texts, codes, model), lm.SLICE
    try:
        lm.SLICE = 2
        assert np.allclose(lm.costs(texts, codes, model), whole)
    finally:
        lm.SLICE = before
    # nothing learned: every bit costs one, of a code and, for the others, of their spelling
    letters = [sum(codes.letters.sizes[list(w + lm.END)]) for w in texts.tail]
    assert np.allclose(whole, codes.words.sizes[texts.numbers] + np.bincount(np.flatnonzero(texts.numbers == codes.escape), weights=letters, minlength=len(whole)), rtol=0.01)
