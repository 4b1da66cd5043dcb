"""Passages of the language model: contexts and what follows them, in tables that grow with the corpus.

A place in a text is an anchor when the hash of the three words before it is a
multiple of ``EVERY``, so the same words have the same anchors in every text.  The
words from an anchor to the next, or to the end, are a passage.  One more bit is
coded at an anchor whose three words other training documents have: whether the
passage is the one that follows them most often there.  If it is, all its words are
coded by that bit; if not, they are coded as other words are.  The bit's chance is
learned from all training documents, gated by how often the expected passage and
the next best have been seen.

A document's own passages are left out when it is coded.  (Otherwise the chances
would be learned from tables that have always seen the passage to come, and a
training document's score would only say that it was trained on.)  What is left out
is the passage itself; another passage of the document after the same three words
counts as any other document's.

The tables are DataFrames of (context, passage, times), joined by the context.  A
row is a passage of a document, so copies and repeats make no pairs; counts are
summed before they are shuffled, and at most two passages a context are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, unstage

#: Words to an anchor, on average, and words of a context.
EVERY, BEFORE = 16, 3
#: Least counts of the levels that gate the bit.
LEVELS = (1, 2, 3, 5, 9)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: An odd base of passages' hashes, and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arrays of unsigned 64-bit integers are changed in place."""
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def passages(hashes: np.ndarray, owner: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, context and hash of every passage of texts laid end to end.

    ``hashes`` has a number for each word, ``owner`` the text it belongs to.
    """
    n = len(hashes)
    if n <= BEFORE:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    context = mix(hashes[: n - BEFORE] + _C)
    for k in range(1, BEFORE):
        context = mix(context + hashes[k : n - BEFORE + k] * _A)
    first = np.flatnonzero((context % np.uint64(every) == 0) & (owner[:-BEFORE] == owner[BEFORE:])) + BEFORE
    ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, n)
    last = ends[np.searchsorted(ends, first, side="right")]
    np.minimum(last[:-1], first[1:], out=last[:-1])
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _powers(_BASE, n)[:n])))
    whole = (sums[last] - sums[first]) * _powers(_BACK, n)[first]
    return first, last, context[first - BEFORE], mix(whole + (last - first).astype(np.uint64) * _A)


def by_document(owner: np.ndarray, context: np.ndarray, whole: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated passages of a text as one: text, context, passage, times, bits of all."""
    same = mix(whole + mix(context + owner.astype(np.uint64) * _A))
    _, at, inverse, times = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(owner[at], kind="stable")
    total = np.bincount(inverse, weights=bits, minlength=len(at)).astype(np.float64)
    return owner[at][order], context[at][order], whole[at][order], times[order], total[order]


def _level(count: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LEVELS, 1):
        out = F.when(count >= least, k).otherwise(out)
    return out


def expected(rows: DataFrame) -> DataFrame:
    """(context, p1, n1, p2, n2): the two passages that follow a context most often in training documents."""
    counts = rows.filter(~F.col("held")).groupBy("context", "passage").agg(F.sum("times").alias("n"))
    order = Window.partitionBy("context").orderBy(F.desc("n"), "passage")
    best = counts.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    of = lambda name, rank: F.max(F.when(F.col("rank") == rank, F.col(name)))
    return best.groupBy("context").agg(of("passage", 1).alias("p1"), of("n", 1).alias("n1"), of("passage", 2).alias("p2"), F.coalesce(of("n", 2), F.lit(0)).alias("n2"))


def coded(rows: DataFrame) -> DataFrame:
    """(row, bits): what the passages' bits change in the cost of each document.

    ``rows`` has a passage of a document each: ``row``, ``held``, ``context``,
    ``passage``, ``times`` and ``bits``, the cost of its words at all those times.
    """
    met = rows.join(expected(rows).hint("merge"), "context")
    own = F.when(F.col("held"), 0).otherwise(F.col("times"))
    first, second = F.col("passage") == F.col("p1"), F.coalesce(F.col("passage") == F.col("p2"), F.lit(False))
    n1 = F.col("n1") - F.when(first, own).otherwise(0)
    n2 = F.col("n2") - F.when(second, own).otherwise(0)
    met = met.select("row", "held", "times", "bits", n1.alias("n1"), n2.alias("n2"), first.alias("first"), second.alias("second"))
    # without its own passage the other may be the expected one; of equal counts the first
    leads = F.col("n1") >= F.col("n2")
    seen, other = F.greatest("n1", "n2"), F.least("n1", "n2")
    hit = F.when(leads, F.col("first")).otherwise(F.col("second"))
    cell = (_level(seen) * (len(LEVELS) + 1) + _level(other)) * 2 + hit.cast("int")
    met = staged(met.filter(seen > 0).select("row", "held", "times", cell.cast("int").alias("cell"), F.when(hit, F.col("bits")).otherwise(0.0).alias("bits")), "lm-passages")
    counts = dict(met.filter(~F.col("held")).groupBy("cell").agg(F.sum("times")).collect())  # a row for each cell at most
    chances = np.zeros(2 * (len(LEVELS) + 1) ** 2)
    for k in range(0, len(chances), 2):
        miss, hits = counts.get(k, 0), counts.get(k + 1, 0)
        chances[k + 1] = (hits + 0.4) / (hits + miss + 0.8)
        chances[k] = 1 - chances[k + 1]
    cost = F.array(*[F.lit(float(-np.log2(c))) for c in chances])[F.col("cell")]
    out = staged(met.groupBy("row").agg(F.sum(F.col("times") * cost - F.col("bits")).alias("bits")), "lm-coded")
    unstage(met)
    return out
