"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered.  One weight vector over sparse text features is
shared by all thresholds: P(grade > k) = 1 / (1 + exp(-(w.x - t_k))), with
t_0 < t_1 < ...  The expected severity is the sum of those probabilities.

Features are the presence of a word (A-Z in lower case) and of a word's first
three to six letters.  Those that the labelled documents use no differently
across grades are screened out by a two-proportion z statistic.

Features are counted and screened over all labelled documents, and as many are
kept as pass.  Labels go to the documents in blocks of some ``BLOCK``, each with a
pass over the documents, so no text is shuffled and no task holds all labels.  Only the weights are fitted on a sample of at most ``SAMPLE``
labelled rows, chosen by a hash of the id; scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import refuse_clash, small_batches, staged, text_of, unstage

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 20_000
LEAST_Z, LEAST_DOCS = 6.0, 5
#: Labels that are sent to all tasks at once, and features that a task holds before handing their counts on.
BLOCK, HELD = 1 << 20, 200_000
#: A grade counts as reached from this probability of it or a higher one.
REACHED_FROM = 0.35
#: Steps of the fit at most, gradients it remembers, and the ridge.
STEPS, MEMORY, RIDGE = 80, 10, 1e-3
_PREFIXES = (3, 4, 5, 6)
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c < 0x41 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def features_of(text: str) -> set[str]:
    """Words, and their first letters with a mark."""
    out = set(text.encode().translate(_FOLD).decode("utf-8", "replace").split())
    out.update([w[:k] + "*" for w in out for k in _PREFIXES if len(w) >= k])
    return out


@dataclass
class Ordinal:
    names: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(at: np.ndarray, of: np.ndarray, width: int, grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by likelihood with a ridge.

    Row ``at[i]`` has feature ``of[i]``; all else is absent.
    Grades nobody has leave a threshold at an end: it stays where a pseudo-count puts it.
    """
    n, rows = len(grades), np.arange(len(grades))
    above = np.array([(np.sum(grades > k) + 0.5) / (n + 1.0) for k in range(levels - 1)])
    cuts = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(levels - 1))
    start = np.concatenate((np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))))
    thresholds = lambda theta: theta[width] + np.concatenate(([0.0], np.cumsum(np.exp(theta[width + 1 :]))))

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = theta[:width], thresholds(theta)
        s = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=w[of], minlength=n)[:, None] - t[None, :], -30, 30)))
        full = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))), axis=1)
        p = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-12)
        # d log p / d (score - t_k)
        by_cut = np.zeros((n, levels + 1))
        by_cut[rows, grades] += slope[rows, grades] / p
        by_cut[rows, grades + 1] -= slope[rows, grades + 1] / p
        by_cut = by_cut[:, 1:-1]
        g_t = by_cut.sum(axis=0) / n
        gaps = [np.exp(theta[width + 1 + k]) * g_t[k + 1 :].sum() for k in range(levels - 2)]
        # the gaps' logarithms are held to their start, so that a grade nobody has cannot drift off
        held = theta[width + 1 :] - start[width + 1 :]
        gradient = np.concatenate((-np.bincount(of, weights=by_cut.sum(axis=1)[at], minlength=width) / n + RIDGE * w, [g_t.sum()], gaps + RIDGE * held))
        return float(-np.log(p).sum() / n + RIDGE / 2 * (w @ w + held @ held)), gradient

    theta = _descend(loss, start)
    return theta[:width], thresholds(theta)


def _descend(loss, x: np.ndarray) -> np.ndarray:
    """The least of a smooth function by quasi-Newton steps with a bounded memory."""
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(gradient).max(initial=0.0) < 1e-6:
            break
        way, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        size = 1.0 if steps else min(1.0, 1.0 / np.abs(gradient).max())
        slope = -(way @ gradient)
        while size > 1e-8:
            new, fresh = loss(x - size * way)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        move, change = -size * way, fresh - gradient
        if move @ change > 1e-12:
            steps = [*steps, (move, change)][-MEMORY:]
        x, value, gradient = x + move, new, fresh
    return x


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels by grade of documents that have each feature, and all of a grade under the empty one."""
    seen: dict[tuple[str, int], int] = {}

    def out() -> pa.RecordBatch:
        keys = list(seen)
        batch = pa.record_batch(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "grade", "n"]
        )
        seen.clear()
        return batch

    for batch in batches:
        for text, grade, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for f in (*features_of(text), ""):
                seen[f, grade] = seen.get((f, grade), 0) + times
            if len(seen) >= HELD:
                yield out()
    if seen:
        yield out()


def feature_counts(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """(feature, all, high) over ``texts`` (``id``, ``text``) with a grade in ``labelled``
    (``id``, ``grade``, ``times``), which goes to every task."""
    found = texts.join(F.broadcast(labelled), "id").select("text", "grade", "times")
    counted = found.mapInArrow(_presence, "feature string, grade int, n long").groupBy("feature")
    return counted.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("high"))


def _present(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in batches:
            found = [sorted(known[f] for f in features_of(x) & known.keys()) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "grade"])

    return run


def severity(toxic: Column, quality: Column) -> Column:
    """Grades from labels alone: 0, not toxic; 1, toxic; 2, toxic in a text of no quality."""
    return F.when(toxic == 1, F.when(quality == 0, 2).otherwise(1)).when(toxic == 0, 0)


def train(documents: DataFrame, labels: DataFrame, grade: Column, levels: int, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, block: int = BLOCK) -> Ordinal:
    """Fit on labelled documents.  Rows without an id, or with a grade that is null
    or not in 0..levels-1, are left out.  Labels of one id repeat its document, and
    repeated documents repeat their labels: each such row counts, and at most
    ``sample`` of them are fitted on.  Without labels of both kinds the model says
    what there is.
    """
    spark = documents.sparkSession
    small_batches(spark)
    graded = labels.select(labels[id_column].alias("id"), grade.cast("int").alias("grade")).dropna().filter(F.col("grade").between(0, levels - 1))
    texts = documents.select(documents[id_column].alias("id"), text_of(documents, text_column).alias("text"))
    # labels of one id and grade are one row, so no id makes a block large
    labelled = staged(graded.groupBy("id", "grade").agg(F.count("*").alias("times")), "toxicity-labels")
    blocks = max(1, -(-labelled.count() // block))
    of_block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = [staged(feature_counts(texts, labelled.filter(of_block == k)), "toxicity-part") for k in range(blocks)]
    summed = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        summed = summed.groupBy("feature").agg(F.sum("all").alias("all"), F.sum("high").alias("high"))
    counted = staged(summed.filter((F.col("all") >= LEAST_DOCS) | (F.col("feature") == "")), "toxicity-counts")
    unstage(labelled, *parts)
    whole = counted.filter("feature = ''").first()
    n, high = (whole["all"], whole["high"]) if whole else (0, 0)
    if not high or high == n:
        return Ordinal({}, np.zeros(0), np.where(np.arange(levels - 1) < (levels - 1 if high == 0 else 0), 20.0, -20.0))
    low = n - high
    share = F.col("all") / n
    z = (F.col("high") / high - (F.col("all") - F.col("high")) / low) / F.sqrt(share * (1 - share) * (1 / high + 1 / low) + 1e-12)
    rows = counted.filter((F.col("feature") != "") & (F.col("all") >= LEAST_DOCS)).select("feature", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    names = {r[0]: k for k, r in enumerate(rows.orderBy(F.desc("z"), "feature").collect())}
    chosen = graded.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    known = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` small rows are sent
    # repeated documents can make more of them again
    known = known.orderBy(F.xxhash64("id"), F.xxhash64("text"), "grade").limit(sample).select("text", "grade")
    found = known.mapInArrow(_present(spark.sparkContext.broadcast(names)), "found array<int>, grade int").collect()
    at = np.repeat(np.arange(len(found)), [len(own) for own, _ in found])
    of = np.array([k for own, _ in found for k in own], dtype=np.int64)
    grades = np.array([r[1] for r in found], dtype=np.int64)
    return Ordinal(names, *fit_ordinal(at, of, len(names), grades, levels))


def _scorer(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = {f: float(model.weights[k]) for f, k in model.names.items()}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.array([sum(sorted(weights[f] for f in features_of(x) & weights.keys())) for x in texts], dtype=np.float64)
            above = model.above(scores)
            grade = (above >= REACHED_FROM).sum(axis=1)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch(
                [*columns, pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(grade > 0)], schema=schema
            )

    return run


def score(documents: DataFrame, model: Ordinal, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """A row per document: the carried columns, ``expected_severity``, ``grade``
    (the highest that is reached with a probability of at least ``REACHED_FROM``),
    ``p_toxic`` (of any grade above 0) and ``toxic`` (whether the grade is above 0).

    Null and empty texts have no features and get the thresholds' prior.
    Repeated rows and null ids are scored row by row.  Columns that are not
    named are not read; a carried column may not have the name of an added one
    (``ValueError``) or begin with two underscores.
    """
    refuse_clash(carry, ("expected_severity", "grade", "p_toxic", "toxic"))
    spark = documents.sparkSession
    small_batches(spark)
    schema = T.StructType(
        [documents.schema[c] for c in carry]
        + [T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    )
    slim = documents.select(*[documents[c] for c in carry], text_of(documents, text_column).alias("__text"))
    return slim.mapInArrow(_scorer(spark.sparkContext.broadcast(model), to_arrow_schema(schema)), schema)
