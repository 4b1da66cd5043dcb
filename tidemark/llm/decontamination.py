"""Benchmark decontamination by a prefix-filtered set join of word windows.

An item is cut into windows of ``WINDOW`` consecutive words (a shorter item is
one window).  A document is hit where a window occurs in it, word for word.

A window is a set of word shingles with positions.  It can only be contained in
a document that has *all* its shingles, so its prefix, the shingles that must
be looked up, is one: the rarest.  Rarity is counted over all documents, in a
pass of its own.  Then each document looks up its shingles in the prefix index;
the shingle's place in the window gives the one place where the window can
start; the start and the end must lie in the document (position and length
bounds); and what remains is verified word by word.

The index is broadcast only below ``MAX_INDEX_CHARS`` of benchmark text.  A
larger benchmark is split into blocks of items below that bound, each document
is matched against every block, and its hits are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import refuse_clash, small_batches, staged, text_of

WINDOW, SHINGLE = 10, 5
#: Benchmark text of one block, in characters; an index takes about ten times that in memory.
MAX_INDEX_CHARS = 4_000_000

#: A-Z to a-z; other ASCII that is neither letter nor digit to space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3)) & (2**64 - 1) | 1 for k in range(SHINGLE)], dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word numbers; 0 where one is unknown."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(size):
        part = ids[k : k + n]
        mixed = part.astype(np.uint64)
        mixed = (mixed ^ (mixed << np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9)
        out += (mixed ^ (mixed >> np.uint64(31))) * _PLACES[k]
        known &= part > 0
    out |= np.uint64(1)
    out[~known] = 0
    return out


class Index:
    """The windows of a block of items, and after ``order`` the prefix index."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.owners: list[set[str]] = []
        found: dict[tuple[int, ...], int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                window = tuple(ids[k : k + WINDOW])
                at = found.setdefault(window, len(found))
                if at == len(self.owners):
                    self.owners.append(set())
                if item is not None:
                    self.owners[at].add(item)
        self.windows = [np.array(w, dtype=np.int64) for w in found]
        #: shingle size -> sorted hashes of all shingles of the windows that use the size
        self.shingles: dict[int, np.ndarray] = {}
        by_size: dict[int, set[int]] = defaultdict(set)
        for w in self.windows:
            by_size[min(SHINGLE, len(w))].update(_rolling(w, min(SHINGLE, len(w))).tolist())
        self.shingles = {s: np.array(sorted(x), dtype=np.uint64) for s, x in by_size.items()}
        self.counts = {s: np.zeros(len(x), dtype=np.int64) for s, x in self.shingles.items()}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts end to end, each followed by a 0, and how many words each has."""
        get, ids, lengths = self.vocabulary.get, [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = words_of(text)
            lengths[k] = len(own)
            ids.extend(map(get, own))
            ids.append(None)
        return np.array([x or 0 for x in ids] if ids else [], dtype=np.int64), lengths

    def count(self, ids: np.ndarray, into: dict[int, np.ndarray]) -> None:
        for size, known in self.shingles.items():
            hashes = _rolling(ids, size)
            hashes = hashes[hashes > 0]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            np.add.at(into[size], at[known[at] == hashes], 1)

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose the rarest shingle of each window and index the windows by it."""
        entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for number, w in enumerate(self.windows):
            size = min(SHINGLE, len(w))
            hashes = _rolling(w, size)
            rare = counts[size][np.searchsorted(self.shingles[size], hashes)]
            best = min(range(len(hashes)), key=lambda k: (rare[k], int(hashes[k])))
            entries[size].append((int(hashes[best]), number, best))
        self.prefixes = {}
        for size, rows in entries.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            unique, first = np.unique(keys, return_index=True)
            self.prefixes[size] = (unique, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.lengths = np.array([len(w) for w in self.windows])
        self.padded = np.zeros((len(self.windows), WINDOW), dtype=np.int64)
        for k, w in enumerate(self.windows):
            self.padded[k, : len(w)] = w

    def matches(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all verified occurrences in texts laid end to end."""
        starts, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size, (unique, first, window, place) in self.prefixes.items():
            hashes = _rolling(ids, size)
            at = np.flatnonzero(hashes)
            slot = np.minimum(np.searchsorted(unique, hashes[at]), len(unique) - 1)
            hit = unique[slot] == hashes[at]
            at, slot = at[hit], slot[hit]
            times = first[slot + 1] - first[slot]
            rows = np.repeat(first[slot] - np.concatenate(([0], np.cumsum(times)[:-1])) if len(slot) else slot, times) + np.arange(times.sum())
            number = window[rows]
            start = np.repeat(at, times) - place[rows]
            # position and length bounds: the window lies in the text that has the shingle
            text = np.searchsorted(ends, np.repeat(at, times), side="right")
            low = np.where(text > 0, ends[np.maximum(text - 1, 0)], 0)
            fits = (start >= low) & (start + self.lengths[number] <= ends[text] - 1)
            start, number = start[fits], number[fits]
            cells = np.minimum(start[:, None] + np.arange(WINDOW), len(ids) - 1)
            same = (ids[cells] == self.padded[number]) | (np.arange(WINDOW) >= self.lengths[number][:, None])
            whole = same.all(axis=1)
            starts.append(start[whole])
            numbers.append(number[whole])
        return np.concatenate(starts), np.concatenate(numbers)


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Union of half-open intervals as a flat list of starts and ends."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _counter(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        into = {s: np.zeros(len(x), dtype=np.int64) for s, x in own.shingles.items()}
        for batch in batches:
            own.count(own.ids(batch.column(0).to_pylist())[0], into)
        for size, counts in into.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array(np.full(len(at), size), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=["size", "shingle", "n"],
            )

    return run


def _matcher(index, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            ids, lengths = own.ids(batch.column(batch.num_columns - 1).to_pylist())
            ends = np.cumsum(lengths + 1)
            spans, items = [[] for _ in lengths], [set() for _ in lengths]
            if own.windows:
                starts, numbers = own.matches(ids, ends)
                text = np.searchsorted(ends, starts, side="right")
                low = np.concatenate(([0], ends))[text]
                for t, s, number in zip(text.tolist(), (starts - low).tolist(), numbers.tolist(), strict=True):
                    spans[t].append((s, s + int(own.lengths[number])))
                    items[t].update(own.owners[number])
            yield pa.record_batch(
                [
                    *[batch.column(k) for k in range(carried)],
                    pa.array(lengths, pa.int64()),
                    pa.array(map(_merge, spans), pa.list_(pa.int64())),
                    pa.array(map(sorted, items), pa.list_(pa.string())),
                ],
                names=[*batch.schema.names[:carried], "n_words", "hit_spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, bound: int) -> list[DataFrame]:
    """Blocks of items of at most about ``bound`` characters each, by a hash of the item."""
    slim = benchmark.select(benchmark[id_column].cast("string").alias("item"), text_of(benchmark, text_column).alias("text"))
    total = slim.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-total // bound) or 1
    if n == 1:
        return [slim]
    return [slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _indexed(spark: SparkSession, slim: DataFrame, block: DataFrame):
    index = Index([(r[0], r[1]) for r in block.collect()])  # at most about MAX_INDEX_CHARS
    if not index.windows:
        index.order(index.counts)
        return spark.sparkContext.broadcast(index)
    first = spark.sparkContext.broadcast(index)
    counted = (
        slim.select("__text").mapInArrow(_counter(first), "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    )
    counts = {s: np.zeros(len(x), dtype=np.int64) for s, x in index.shingles.items()}
    for size, shingle, n in counted.collect():  # one row for each benchmark shingle at most
        counts[size][shingle] = n
    index.order(counts)
    return spark.sparkContext.broadcast(index)


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    max_index_chars: int = MAX_INDEX_CHARS,
) -> DataFrame:
    """A row per document: the carried columns, ``n_words``, ``hit_spans`` (starts
    and ends of hit runs of words, flat, ends exclusive), ``items`` (ids of items
    with an occurring window, sorted as strings) and ``n_hit``.

    Null and empty texts have no words; an item without words has no window.  An
    item with a null id hits but is not listed.  Equal items are one window set
    with all their ids.  Documents that repeat are matched row by row.  Columns
    that are not named are not read; a carried column may not have the name of an
    added one or begin with two underscores (``ValueError``).
    """
    refuse_clash(carry, ("n_words", "hit_spans", "items", "n_hit"))
    spark = documents.sparkSession
    small_batches(spark)
    slim = documents.select(*[documents[c] for c in carry], text_of(documents, text_column).alias("__text"))
    blocks = _blocks(benchmark, item_column, item_text_column, max_index_chars)
    made = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    schema = T.StructType([documents.schema[c] for c in carry] + made)
    if len(blocks) == 1:
        out = slim.mapInArrow(_matcher(_indexed(spark, slim, blocks[0]), len(carry)), schema)
    else:
        rows = staged(slim.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
        keyed = T.StructType([T.StructField("__row", T.LongType()), *schema])
        parts = None
        for block in blocks:
            part = rows.select("__row", *carry, "__text").mapInArrow(_matcher(_indexed(spark, rows, block), len(carry) + 1), keyed)
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("__row").agg(
            *[F.first(c).alias(c) for c in (*carry, "n_words")],
            F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        out = merged.select(*carry, "n_words", "hit_spans", "items").mapInArrow(_union(len(carry) + 1), schema)
    pairs = F.expr("aggregate(sequence(0, size(hit_spans) div 2 - 1), 0L, (n, k) -> n + hit_spans[2 * k + 1] - hit_spans[2 * k])")
    return out.withColumn("n_hit", F.when(F.size("hit_spans") > 0, pairs).otherwise(F.lit(0).cast("long")))


def _union(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column(at).to_pylist()]
            columns = [batch.column(k) if k != at else pa.array(spans, pa.list_(pa.int64())) for k in range(batch.num_columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return run
