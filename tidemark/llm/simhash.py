"""SimHash near-duplicates over deletion-variant signatures.

A fingerprint has a bit for each bit of the 64-bit shingle hashes, set where
over half of the hashes have it set.  Two fingerprints link when they differ
in at most four bits.  Cut into three segments, one segment of such a pair
differs in at most one bit, so the pair agrees on that segment with one bit
left out.  Each distinct fingerprint is therefore listed under 64 signatures:
a segment and the bit of it that is left out.  An equality join brings
candidates together, and the distance is verified in the join condition, which
also lets a pair through under one signature only.

Copies never meet each other: fingerprints are made distinct first, and
documents come back by joining on the fingerprint.

The fingerprints that share a signature are compared in one place, and a spanning
forest of their links comes out, which connects the same.  Signatures of more than
``IN_PLACE`` fingerprints, counted beforehand, are not brought together.  They are
made longer first: their pairs differ in at most four of the bits outside the
segment, so of five parts of those bits one is equal.  What is crowded even then
is a huge group of near copies.  Its fingerprints are linked by common neighbours:
each lists the 2,081 values within two bits, and those that share one are linked
to the smallest of them.  All three are exact; brute force is compared with each.

Components are found by spreading the smallest label over the links and
following labels of labels; each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, staged, text_of, unstage

WORDS, SEED, DISTANCE = 4, 42, 4
#: First bit and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Groups whose pairs are compared at one go, those that one task compares in place,
#: and rows that it works on at a time.
FEW, IN_PLACE, TOGETHER = 8, 8192, 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, size: int = WORDS) -> list[int]:
    words = text.encode().lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that over half of the hashes have set; zero for none."""
    if not len(hashes):
        return 0
    by_byte = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        counts = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(_POWERS[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: str, size: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text; zero for one without words."""
    return majority(shingle_hashes(text, size))


def _fingerprints(schema_names: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x, size) for x in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(values.view(np.int64))], names=schema_names)

    return run


def with_fingerprints(
    documents: DataFrame, carry: tuple[str, ...], text_column: str = "text", size: int = WORDS, name: str = "fp"
) -> DataFrame:
    """The carried columns and ``name``, the fingerprint as a signed long."""
    small_batches(documents.sparkSession)
    slim = documents.select(*[documents[c] for c in carry], text_of(documents, text_column).alias("__text"))
    schema = T.StructType([documents.schema[c] for c in carry] + [T.StructField(name, T.LongType())])
    return slim.mapInArrow(_fingerprints(schema.names, size), schema)


def _slots() -> list[tuple[int, int]]:
    """(segment, bit left out) by signature number."""
    return [(k, low + i) for k, (low, width) in enumerate(SEGMENTS) for i in range(width)]


def _segment(k: int) -> int:
    low, width = SEGMENTS[k]
    return ((1 << width) - 1) << low


def _rest(slot: int) -> list[int]:
    """Masks of five parts of the bits outside the segment of a signature."""
    own = [b for b in range(64) if not _segment(_slots()[slot][0]) >> b & 1]
    cuts = [len(own) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [sum(1 << b for b in own[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(x)).cast("long") for x in values])


def signatures(fingerprints: DataFrame) -> DataFrame:
    """(slot, part, fp): each fingerprint under its 64 signatures."""
    masks = [_segment(k) & ~(1 << bit) for k, bit in _slots()]
    listed = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
    return listed.select("slot", F.col("fp").bitwiseAND(_longs(masks)[F.col("slot")]).alias("part"), "fp")


def refined(listed: DataFrame) -> DataFrame:
    """Signatures made longer: a pair that agrees on a segment with one bit left out
    differs in at most four of the other bits, so of five parts of those one is equal."""
    parts = [_longs([_rest(slot)[k] for slot in range(64)])[F.col("slot")] for k in range(DISTANCE + 1)]
    longer = F.explode(F.array(*[F.xxhash64("part", F.lit(k), F.col("fp").bitwiseAND(parts[k])) for k in range(DISTANCE + 1)]))
    return listed.select("slot", longer.alias("part"), "fp")


_SEGMENT_OF = np.array([_segment(k) for k, _ in _slots()], dtype=np.uint64)
_BIT_OF = np.array([1 << bit for _, bit in _slots()], dtype=np.uint64)
_NUMBER_OF = np.array([k for k, _ in _slots()])
_FIRST_OF = np.array([bit == SEGMENTS[k][0] for k, bit in _slots()])


def counts_under(x: np.ndarray, slot) -> np.ndarray:
    """Whether pairs that differ in ``x`` link and count under a signature: under the
    first segment with at most one difference, with that bit, or else the first, left out."""
    own = x & _SEGMENT_OF[slot]
    out = (np.bitwise_count(x) <= DISTANCE) & (x != 0) & ((own == _BIT_OF[slot]) | ((own == 0) & _FIRST_OF[slot]))
    for e in range(len(SEGMENTS) - 1):
        out &= (np.bitwise_count(x & np.uint64(_segment(e))) > 1) | (e >= _NUMBER_OF[slot])
    return out


def forest(slot: int, values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that count under a signature (as positions).

    Each value is held against those that are not connected yet, so a group of n
    takes room for n numbers and at most n * n / 2 comparisons.
    """
    left, stack, out = np.arange(1, len(values)), [0], []
    while len(left):
        if not stack:
            stack.append(int(left[0]))
            left = left[1:]
        at = stack.pop()
        x = values[left] ^ values[at]
        close = np.flatnonzero(np.bitwise_count(x) <= DISTANCE)
        if len(close):
            close = close[counts_under(x[close], slot)]
            near = left[close].tolist()
            left = np.delete(left, close)
            out += [(at, k) for k in near]
            stack += near
    return out


def _linked(slots: np.ndarray, fps: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Links of groups that lie between cuts: small ones by all their pairs, others by a forest."""
    sizes, fps = np.diff(cuts), fps[: cuts[-1]]
    values, group, one, two = fps.view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), [], []
    small = np.repeat(sizes <= FEW, sizes)
    for lag in range(1, min(FEW, int(sizes.max(initial=0)))):
        x = values[lag:] ^ values[:-lag]
        near = np.flatnonzero((np.bitwise_count(x) <= DISTANCE) & (group[lag:] == group[:-lag]) & small[lag:])
        near = near[counts_under(x[near], slots[near])]
        one.append(fps[near])
        two.append(fps[near + lag])
    for k in np.flatnonzero(sizes > FEW).tolist():
        own = slice(int(cuts[k]), int(cuts[k + 1]))
        at = np.array(forest(int(slots[own.start]), values[own]), dtype=np.int64).reshape(-1, 2)
        one.append(fps[own][at[:, 0]])
        two.append(fps[own][at[:, 1]])
    a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *xs]) for xs in (one, two))
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, part, fp) sorted by signature; a signature may go on in the next batch."""
    held: list[list[np.ndarray]] = [[], [], []]
    rows = 0
    for batch in batches:
        for k, column in enumerate(held):
            column.append(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))
        rows += batch.num_rows
        if rows < TOGETHER:
            continue
        slots, parts, fps = map(np.concatenate, held)
        cuts = np.concatenate(([0], np.flatnonzero((slots[1:] != slots[:-1]) | (parts[1:] != parts[:-1])) + 1))
        yield _linked(slots, fps, cuts)
        held, rows = [[x[cuts[-1] :]] for x in (slots, parts, fps)], len(fps) - int(cuts[-1])
    if rows:
        slots, parts, fps = map(np.concatenate, held)
        cuts = np.flatnonzero((slots[1:] != slots[:-1]) | (parts[1:] != parts[:-1])) + 1
        yield _linked(slots, fps, np.concatenate(([0], cuts, [len(fps)])))


def _by_forests(listed: DataFrame) -> DataFrame:
    together = listed.repartition("slot", "part").sortWithinPartitions("slot", "part", "fp")
    return together.mapInArrow(_forests, "a long, b long")


def _crowded(listed: DataFrame, most: int) -> DataFrame:
    """(slot, part) of more than ``most`` fingerprints, counted with partial sums."""
    counted = listed.groupBy("slot", "part").agg(F.count("*").alias("n"))
    return staged(counted.filter(F.col("n") > most).select("slot", "part"), "simhash-crowded")


def _stars(crowd: DataFrame) -> DataFrame:
    """Links of distinct fingerprints by common neighbours.

    Two within four bits have a value within two bits of both, and all around one
    value are within four bits of each other.  So those that share a value are
    linked to the smallest of them.
    """
    around = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    near = crowd.select("fp", F.explode(_longs(around)).alias("v")).select("fp", F.col("fp").bitwiseXOR(F.col("v")).alias("value"))
    first = near.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a < last").select("value", "a")
    return near.join(first.hint("merge"), "value").filter("a < fp").groupBy("a", F.col("fp").alias("b")).agg(F.count("*").alias("n")).select("a", "b")


def links(fingerprints: DataFrame, place: int = IN_PLACE) -> DataFrame:
    """Pairs (a, b) that connect what is within ``DISTANCE`` bits, staged.

    ``fingerprints`` has the distinct values in ``fp``.
    """
    listed = signatures(fingerprints)
    crowded = _crowded(listed, place)
    if crowded.isEmpty():
        return staged(_by_forests(listed), "simhash-links")
    found = _by_forests(listed.join(crowded.hint("merge"), ["slot", "part"], "left_anti"))
    longer = refined(listed.join(crowded.hint("merge"), ["slot", "part"], "left_semi"))
    still = _crowded(longer, place)
    found = found.unionByName(_by_forests(longer.join(still.hint("merge"), ["slot", "part"], "left_anti")))
    if not still.isEmpty():
        crowd = staged(longer.join(still.hint("merge"), ["slot", "part"], "left_semi").select("fp").distinct(), "simhash-crowd")
        found = found.unionByName(_stars(crowd))
    return staged(found, "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the smallest node that can be reached.

    Labels spread over the links and then follow the label's own label; all
    joins are shuffled, as links and labels grow with the data.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    both = staged(edges.select(ends.alias("e")).select("e.u", "e.v"), "simhash-edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "simhash-labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    while before is not None:
        seen = both.join(labels.hint("merge"), both["v"] == labels["node"]).select(F.col("u").alias("node"), "label")
        spread = seen.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        follow = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        last, labels = labels, staged(
            spread.join(follow.hint("merge"), "label", "left").select("node", F.coalesce("further", "label").alias("label")), "simhash-labels"
        )
        unstage(last)
        now = labels.agg(total).first()[0]
        if now == before:
            break
        before = now
    unstage(both)
    return labels


def _grouped(rows: DataFrame, key: Column, place: int = IN_PLACE) -> DataFrame:
    """(fp, first): the least ``key`` among all rows that a fingerprint's links reach."""
    own = staged(rows.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    found = links(own.select("fp"), place)
    labels = components(found)
    labelled = own.join(labels.hint("merge"), own["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    labelled = staged(labelled, "simhash-labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("first"))
    out = staged(labelled.drop("first").join(least.hint("merge"), "label").select("fp", "first"), "simhash-groups")
    unstage(own, found, labels, labelled)
    return out


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, place: int = IN_PLACE
) -> DataFrame:
    """A row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id among the documents that links reach.

    Null and empty texts, and texts of blanks, have fingerprint zero and link
    like any other.  Null ids are passed over when the smallest is taken (it is
    null where all are).  Repeated rows stay.  Other columns are not read.
    """
    ids = documents.select(documents[id_column].alias("doc_id"), documents[text_column].alias("text"))
    rows = staged(with_fingerprints(ids, ("doc_id",), "text", size), "simhash-fingerprints")
    groups = _grouped(rows, F.col("doc_id"), place)
    return rows.join(groups.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def drop_near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = WORDS, place: int = IN_PLACE
) -> DataFrame:
    """The documents, all columns, with one row of each group: that of the smallest
    id (null ids last), and of equal ids the first read.

    Column names that begin with two underscores are taken by this function.
    """
    names = documents.columns
    kept = documents.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", documents[text_column])
    rows = staged(with_fingerprints(kept, (*names, "__row"), "__text", size, "__fp"), "simhash-rows")
    slim = rows.select(F.col("__fp").alias("fp"), F.struct(F.col(id_column).isNull(), F.col(id_column), F.col("__row").alias("row")).alias("key"))
    groups = _grouped(slim, F.col("key"), place)
    stay = groups.select(F.col("first.row").alias("__row")).distinct()
    return rows.join(stay.hint("merge"), "__row", "left_semi").select(*names)
