"""Exact histogram of encoded lengths.

Documents are aggregated by group and encoded length, in each task first and
then over all.  Suffix sums over the lengths answer, for every context limit:
how many documents and ids are at least that long, what is left when documents
are cut there, and which share of documents fits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tokens
from ._common import refuse_clash, small_batches, text_of

#: Distinct (group, length) pairs that a task holds before handing their counts on.
HELD = 100_000


def _lengths(vocabulary: str, pattern: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*key, n) for key, n in held.items()), strict=True))
            held.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns - 1)]
            encoded = [len(tokens.encode(x, vocabulary, pattern)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            held.update(zip(*columns, encoded, strict=True))
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    return run


def length_histogram(
    documents: DataFrame,
    by: tuple[str, ...] = (),
    text_column: str = "text",
    vocabulary: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(by..., ``n_tokens``, ``docs``): documents by encoded length.

    A null text counts as an empty one, of length 0; a null group is a group of
    its own; repeated rows count each.  An empty table has no rows.  A group may
    not be named ``n_tokens`` or ``docs`` or begin with two underscores
    (``ValueError``); further columns are not read.
    """
    refuse_clash(by, ("n_tokens", "docs"))
    small_batches(documents.sparkSession)
    slim = documents.select(*[documents[c] for c in by], text_of(documents, text_column).alias("__text"))
    schema = T.StructType([documents.schema[c] for c in by] + [T.StructField("n_tokens", T.LongType()), T.StructField("docs", T.LongType())])
    run = _lengths(vocabulary or tokens.default_vocabulary(), pattern or tokens.default_pattern(), to_arrow_schema(schema))
    return slim.mapInArrow(run, schema).groupBy(*by, "n_tokens").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For every length that occurs, as a context limit: the histogram's columns and

    ``docs_at_least``, ``tokens_at_least`` (suffix sums), ``truncated_tokens``
    (ids left when documents are cut to the limit), ``total_docs``,
    ``total_tokens`` and ``share_fitting`` (of documents no longer than it: the
    inverse of the quantiles).  The rows of a group are its distinct lengths.
    """
    tokens_here = F.col("docs") * F.col("n_tokens")
    down = Window.partitionBy(*by).orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    out = histogram.select(
        *by,
        "n_tokens",
        "docs",
        F.sum("docs").over(down).alias("docs_at_least"),
        F.sum(tokens_here).over(down).alias("tokens_at_least"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum(tokens_here).over(whole).alias("total_tokens"),
    )
    longer = F.col("docs_at_least")
    return out.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + longer * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - longer + F.col("docs")) / F.col("total_docs")).alias("share_fitting"),
    )


def truncated_total(limits: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ``truncated_tokens``, ``docs_cut``) for any limit, occurring or not."""
    longer = F.col("n_tokens") > limit
    return limits.groupBy(*by).agg(
        F.sum(F.col("docs") * F.least("n_tokens", F.lit(limit))).alias("truncated_tokens"),
        F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("docs_cut"),
    )


def quantile(limits: DataFrame, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ``n_tokens``): the least length that at least ``share`` of the documents fit in."""
    return limits.filter(F.col("share_fitting") >= share).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))
