"""Near-duplicates by the exact similarity of their word shingles.

Two texts link when their sets of ``WORDS``-word shingles have a Jaccard
similarity of at least 4/5.  The first candidates are those of the operator in
``simhash``: fingerprints of the sets, brought together by deletion-variant
signatures, within four bits.  Links of fingerprints are a spanning forest, and of
texts with one fingerprint each is held against the first.  Every candidate is
verified on its texts before it links.

Fingerprints of 64 bits are too coarse for all of 4/5: there some ten of their bits
differ.  So texts that share a band are candidates as well: ``ROWS`` minima of
hashed shingles, of ``BANDS`` times as many.  A pair at exactly 4/5 shares none with
probability (1 - 0.8**6)**30, about 1 in 9,000, and a closer pair more seldom still.

Texts with equal shingle sets are one node, so copies never meet each other.  A
candidate of a band is first held against a bound that needs no text: the symmetric
difference is at least the difference of the sizes, and at least the number of
bits in which the sets' parity maps differ.  The bound drops no linked pair.

In a band that more than ``FEW`` nodes share, pairs would grow with the square.
There, rounds compare nodes with leaders, one for each ``GROUP`` nodes or so, and
what is already connected is not compared again.  When the pairs between groups are few, or rounds no longer
help, all that are left are compared, so nothing is passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._common import marked, marks, release, small_batches, staged, text_of, unstage
from .simhash import components, shingle_hashes

WORDS, BANDS, ROWS = 5, 30, 6
#: Nodes of a band whose pairs are all compared at once, and pairs a node up to which rounds by leader end.
FEW, PAIRS = 16, 8
#: Nodes of a large band that one leader meets in a turn.
GROUP = 512
_LONGS = 16
_r = np.random.default_rng(42)
_FACTORS = _r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _r.integers(0, 1 << 63, ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SLICE = 1024


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, WORDS), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a similarity of at least 4/5; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def bands(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), _SLICE):
        np.minimum(least, (own[k : k + _SLICE, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def parity(own: np.ndarray) -> np.ndarray:
    """A bit by the first ten of a shingle's hash: whether an odd number of shingles has them."""
    odd = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=64 * _LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            made = [
                pa.array([hashlib.md5(x.tobytes()).digest() for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array(np.array([simhash.majority(x) for x in sets], dtype=np.uint64).view(np.int64)),
                pa.array([parity(x) for x in sets], pa.list_(pa.int64())),
                pa.array([bands(x) for x in sets], pa.list_(pa.int64())),
            ]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema)

    return run


def _possible(a: str, b: str) -> Column:
    """What a pair of similarity 4/5 must meet: nine times the difference is at most the sum of the sizes."""
    most = F.col(f"{a}.size") + F.col(f"{b}.size")
    bits = sum((F.bit_count(F.col(f"{a}.parity")[k].bitwiseXOR(F.col(f"{b}.parity")[k])) for k in range(_LONGS)), F.lit(0))
    return (9 * F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= most) & (9 * bits <= most)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = lru_cache(maxsize=64)(shingles)
    for batch in batches:
        same = [alike(known(x), known(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["one", "two"]).filter(pa.array(same, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct links (a, b) between the labels of pairs whose texts are alike.

    Of the texts only those that pairs name are shuffled (and a few that bits take for them).
    """
    pairs = staged(pairs.distinct(), "similar-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    near = marked(texts, "node", marks(named, 2 * pairs.count())).filter("__marked").select("node", "text")
    few = staged(near.join(named.distinct().hint("merge"), "node", "left_semi"), "similar-texts")
    release(texts.sparkSession)
    one, two = (few.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    whole = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").sortWithinPartitions("a").select("one", "two", "text_a", "text_b")
    found = whole.mapInArrow(_verify, "one long, two long")
    made = staged(found.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "similar-links")
    unstage(pairs, few)
    release(texts.sparkSession)
    return made


def fingerprinted(nodes: DataFrame, place: int = simhash.IN_PLACE) -> DataFrame:
    """Candidates (a, b, one, two), staged: nodes (``node``, ``fp``) of one fingerprint
    against the first of them, and the first nodes of fingerprints that
    deletion-variant signatures link.  At most a few for each node.
    """
    firsts = staged(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "similar-fingerprints")
    found = simhash.links(firsts.select("fp"), place)
    one, two = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    across = found.distinct().join(one.hint("merge"), "a").join(two.hint("merge"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = nodes.join(firsts.filter("n > 1").select("fp", "first").hint("merge"), "fp").filter("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs.select("a", "b", F.col("a").alias("one"), F.col("b").alias("two")), "similar-candidates")
    unstage(firsts, found)
    release(nodes.sparkSession)
    return pairs


def _labelled() -> list[Column]:
    return [F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("one"), F.col("b.label").alias("two")]


def _pairs(rows: DataFrame, more: Column | None = None) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node"))
    joined = a.join(b.hint("merge"), (same if more is None else same & more) & _possible("a", "b"))
    return joined.select(*_labelled())


def _opened(own: DataFrame, turn: int) -> DataFrame:
    """A row for each node and large band of it, with a number that is drawn anew each turn."""
    drawn = F.xxhash64("node", F.lit(turn))
    return own.withColumn("drawn", drawn).withColumn("band", F.explode("large")).select("*", "band.slot", "band.part", "band.n").drop("large", "band")


def _led(rows: DataFrame) -> DataFrame:
    """Candidates (a, b, one, two): each node against a leader.

    The nodes of a band are dealt by their drawn number to groups of ``GROUP`` or so,
    and the least number leads, so no task holds a whole band, and nodes of several
    bands meet the same leaders.  Of two labels only one pair is tried in a turn.
    """
    parts = F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(GROUP)))), F.lit(0)).cast("int")
    group = F.call_function("shiftrightunsigned", F.col("drawn"), 63 - parts)
    rows = rows.withColumn("group", F.when(parts > 0, group).otherwise(F.lit(0).cast("long")))
    lead = F.min(F.struct("drawn", "node", "size", "parity", "label")).over(Window.partitionBy("slot", "part", "group"))
    met = rows.withColumn("a", lead).filter(F.col("a.label") != F.col("label"))
    met = met.select("a", F.struct("node", "size", "parity", "label").alias("b")).filter(_possible("a", "b"))
    tried = met.groupBy(F.col("a.label").alias("one"), F.col("b.label").alias("two")).agg(F.min(F.struct(F.col("a.node").alias("a"), F.col("b.node").alias("b"))).alias("pair"))
    return tried.select("pair.a", "pair.b", "one", "two")


def links(nodes: DataFrame, texts: DataFrame, few: int = FEW, most: int = PAIRS) -> DataFrame:
    """Pairs (a, b) that connect what verified pairs link.

    ``nodes`` has ``node``, ``size``, ``fp``, ``parity`` and ``bands``; ``texts`` has ``node`` and ``text``.
    """
    close = fingerprinted(nodes.select("node", "fp"))
    listed = nodes.select("node", F.posexplode("bands").alias("slot", "part"))
    counted = listed.withColumn("n", F.count("*").over(Window.partitionBy("slot", "part")))
    shared = staged(counted.filter("n > 1"), "similar-bands")
    slim = nodes.select("node", "size", "parity")
    small = shared.filter(F.col("n") <= few).join(slim.hint("merge"), "node").withColumn("label", F.col("node"))
    edges = _verified(_pairs(small).unionByName(close), texts)
    unstage(close)
    of_node = shared.filter(F.col("n") > few).groupBy("node").agg(F.collect_list(F.struct("slot", "part", "n")).alias("large"))
    large = staged(of_node.join(slim.hint("merge"), "node"), "similar-large")
    unstage(shared)
    before, turn = None, 0
    while not large.isEmpty():
        labels = components(edges)
        own = staged(large.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "similar-open")
        rows = _opened(own, turn)
        groups = rows.groupBy("slot", "part", "label").agg(F.count("*").alias("c"))
        open_ = groups.groupBy("slot", "part").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("double") ** 2).alias("within")).filter("m * m > within")
        members, left = open_.agg(F.sum("m"), F.sum(F.expr("(double(m) * m - within) / 2"))).first()
        if not members:
            unstage(labels, own)
            break
        last = left <= most * members or (before is not None and left > 0.9 * before)
        if last:
            found = _pairs(rows.join(open_.select("slot", "part").hint("merge"), ["slot", "part"], "left_semi"), F.col("a.label") != F.col("b.label"))
        else:
            found = _led(rows)
        # a label stands for all that is connected to it
        known, verified = edges, _verified(found, texts)
        edges = labels.filter("label < node").select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(verified)
        edges = staged(edges, "similar-links")
        unstage(known, labels, verified, own)
        if last:
            break
        before, turn = left, turn + 1
    unstage(large)
    return edges


def drop_similar(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", few: int = FEW, most: int = PAIRS
) -> DataFrame:
    """The documents, all columns, with one row of each group that links reach: that
    of the smallest id (null ids last), and of equal ids the first read.

    Null and empty texts, and texts of blanks, are one group.  A text of at most
    five words is one shingle.  Column names that begin with two underscores are
    taken by this function.
    """
    spark, names = documents.sparkSession, documents.columns
    small_batches(spark)
    kept = staged(documents.withColumn("__row", F.monotonically_increasing_id()), "similar-rows")
    slim = kept.select("__row", F.struct(F.col(id_column).isNull(), F.col(id_column), F.col("__row").alias("row")).alias("key"), text_of(kept, text_column).alias("text"))
    made = [T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType())]
    made += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("parity", "bands")]
    schema = T.StructType([*slim.schema.fields[:2], *made])
    rows = staged(slim.mapInArrow(_sketches(schema.names), schema), "similar-sketches")
    # equal digests are equal sets, so any row's sketch will do
    own = rows.groupBy("digest").agg(F.min("__row").alias("node"), F.min("key").alias("first"), *[F.first(c).alias(c) for c in ("size", "fp", "parity", "bands")])
    own = staged(own, "similar-nodes")
    unstage(rows)
    release(spark)
    edges = links(own, slim.select(F.col("__row").alias("node"), "text"), few, most)
    labels = components(edges)
    labelled = own.select("node", "first").join(labels.hint("merge"), "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
    stay = labelled.agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    gone = staged(kept.select("__row").join(stay.hint("merge"), "__row", "left_anti"), "similar-gone")
    unstage(own, edges, labels)
    release(spark)
    # rows that no bit takes for a copy stay where they are
    split = marked(kept, "__row", marks(gone, gone.count()))
    doubtful = split.filter("__marked").join(gone.hint("merge"), "__row", "left_anti")
    return split.filter("not __marked").select(*names).unionByName(doubtful.select(*names))
