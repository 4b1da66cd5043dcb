"""Packing token sequences by minimum bin slack.

Each task packs the documents of its own input partition, a block at a time:

* whole windows of ``capacity`` ids are taken from long documents at once, and
  what remains of each document goes into a pool of lengths below capacity;
* when the pool holds a block of ids, windows are filled.  The largest length
  anchors a window; a bitset subset-sum over the counts of the other lengths
  finds the multiset that comes closest to the rest of the window, and walking
  the kept bitsets backwards gives how often each length is used.  The same
  multiset is used as often as the counts allow;
* where the closest multiset still leaves slack, one more remainder is cut to
  fill it (documents may be cut anywhere), and its tail stays in the pool;
* at the end of the partition the last ids, fewer than a window, go to
  sequences whose lengths are powers of two, which need no padding.

So no sequence needs padding.  There is no shuffle, no state beyond one block,
and no driver work: a task that is lost is run again from its input.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokens
from ._common import small_batches, text_of

#: Ids in the pool before its windows are filled.
BLOCK_TOKENS = 1 << 20


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than counted, whose sum comes
    closest to ``room`` from below: length -> how often.

    Bits of an integer are the sums that can be reached.  A count is split into
    powers of two, so that each step is one shift; the bitsets before the steps
    are kept to walk back.  Larger lengths come first, and the search ends as
    soon as the room can be filled to the last id.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], room // length if length else 0), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] += times
            total -= length * times
    return dict(used)


class _Packer:
    """The state of one task: the pool by length, and the rows not yet handed on."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)
        self.pooled = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self._place([(doc_id, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self._return((doc_id, whole, ids[whole:], total))

    def _return(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.pooled += len(piece[2])

    def _take(self, length: int) -> tuple:
        at = self.pool[length]
        piece = at.popleft()
        if not at:
            del self.pool[length]
        self.pooled -= length
        return piece

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), total, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1

    def _cut(self, size: int) -> list[tuple]:
        """Pieces of ``size`` ids in all, the last of them cut where it must be."""
        pieces = []
        while size:
            fits = [x for x in self.pool if x <= size]
            length = max(fits) if fits else min(self.pool)
            doc_id, start, ids, total = self._take(length)
            pieces.append((doc_id, start, ids[:size], total))
            if length > size:
                self._return((doc_id, start + size, ids[size:], total))
            size -= min(size, length)
        return pieces

    def fill(self, keep: int = 0) -> None:
        """Fill windows while the pool holds ``keep`` ids and a window."""
        while self.pooled >= max(keep, self.capacity):
            counts = {length: len(at) for length, at in self.pool.items()}
            anchor = max(counts)
            counts[anchor] -= 1
            used = closest_multiset({k: v for k, v in counts.items() if v}, self.capacity - anchor)
            used[anchor] = used.get(anchor, 0) + 1
            slack = self.capacity - sum(k * v for k, v in used.items())
            counts[anchor] += 1
            again = 1 if slack else min(counts[k] // v for k, v in used.items())
            for _ in range(again):
                pieces = [self._take(k) for k, v in used.items() for _ in range(v)]
                self._place(pieces + (self._cut(slack) if slack else []))

    def finish(self) -> None:
        self.fill()
        while self.pooled:
            self._place(self._cut(1 << (self.pooled.bit_length() - 1)))


def _pack_partition(capacity: int, vocabulary: str, pattern: str, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get()
        packer = _Packer(capacity, (at.partitionId() if at else 0) << 40)

        def out(most: int) -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            for k in range(0, len(rows), most):
                columns = list(zip(*rows[k : k + most], strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.append(tokens.encode(text, vocabulary, pattern), np.uint32(end_id)).astype("<u4"))
                if packer.pooled >= BLOCK_TOKENS:
                    packer.fill(BLOCK_TOKENS // 8)
                if len(packer.rows) >= 1024:
                    yield from out(1024)
        packer.finish()
        yield from out(1024)

    return run


def pack(
    documents: DataFrame,
    capacity: int = 1024,
    vocabulary: str | None = None,
    pattern: str | None = None,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids.

    Returns a row per piece: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``doc_tokens`` (of its document, end id included),
    ``sequence_id``, ``offset`` in the sequence, and ``ids`` (little-endian
    unsigned 32-bit).  Every sequence is full or has a power of two of ids.

    A null or empty text is the end id alone.  A null id stays null.  Repeated
    rows are packed as often as they occur.  Of an empty table nothing is
    returned.  Other columns are not read, so their names cannot clash.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    small_batches(documents.sparkSession)
    id_type = documents.schema[id_column].dataType
    slim = documents.select(documents[id_column].alias("doc_id"), text_of(documents, text_column).alias("text"))
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(n, long) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _pack_partition(
        capacity,
        vocabulary or tokens.default_vocabulary(),
        pattern or tokens.default_pattern(),
        end_id,
        to_arrow_schema(schema),
    )
    return slim.mapInArrow(run, schema)
