"""A corpus pipeline: documents in, packed token sequences out.

Each stage calls one operator of ``tidemark.llm`` on all that the stage before
it kept, and its decisions take effect: lines and documents that fail the
quality rules go, one document of each group of near-duplicates stays, documents
with benchmark passages go, secrets are replaced by a mark, and what remains is
packed.  All stages but the last return the columns of their input; ``run`` writes their
rows to the shared folder and reads them back for the next.

Null texts and texts of fewer than twenty words do not pass the first stage.
Repeated rows are one group of near-duplicates.  Further columns pass through,
whatever their names, if they do not begin with two underscores.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, packing, quality, secrets, similar
from tidemark.llm._common import staged

#: Encoding and packing are beyond SQL; tests/llm/test_pipeline_plain.py has a plain version.
ORACLE_SQL = None


def _held(docs: DataFrame, *without: str) -> DataFrame:
    """The text, and all other columns as one, so that no name can clash (and one that
    is always there, as a struct of nothing cannot be)."""
    rest = [docs[c] for c in docs.columns if c not in without]
    return docs.select(F.struct(*rest, F.lit(0).alias("__none")).alias("__doc"), docs["text"].alias("text"))


def _columns(names: list[str], text: Column | None = None) -> list[Column]:
    """The columns of a held table in their old order, with a new text and its length if given."""
    made = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return [made.get(c, F.col("__doc")[c]).alias(c) for c in names]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(_held(docs, "text"), carry=("__doc",))
    return judged.filter("kept").select(*_columns(docs.columns, F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(_held(docs), benchmark, carry=("__doc",))
    return found.filter("n_hit = 0").select(*_columns(docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(_held(docs), carry=("__doc",))
    return found.select(*_columns(docs.columns, secrets.redact(F.col("__doc")["text"], F.col("spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
