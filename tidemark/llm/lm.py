"""A language model by online logistic context mixing.

A text is its words in lower case and an end.  Every word is a string of bits:
frequent words have Huffman codes over their counts in the training documents,
and any other word is an escape code followed by its bytes in a Huffman code of
bytes.  So the bits' probabilities multiply to a probability of the text.

A bit of a word is predicted in four contexts: its place in the code alone, with
the word before, with the two before, and with the second one before; a bit of a
spelled byte by its place, with one, two and three bytes before, and alone.  The
predictions are mixed in the logistic domain; the weights are gated by how much
the contexts have seen.  An adaptive map corrects the mix by what came of earlier
predictions like it.

These contexts hash to ``2**TABLE_BITS`` slots each, which every scorer holds.  What
follows longer contexts lies in tables that grow with the corpus (``lm_passages``):
there, one bit codes all words of a passage that other documents have.

Learning covers every training document.  A task takes its documents in steps
and, for each, predicts with what it has counted so far, corrects weights and map
by the errors, and then counts the step.  Counts and maps of all tasks add up, in
blocks; weights are averaged by the bits behind them.  Word counts are exact.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import lm_passages
from ._common import refuse_clash, small_batches, staged, text_of

END = b"\n"
#: Words with codes of their own, and slots (as a power of two) for each context of bounded size.
HEAD, TABLE_BITS = 1 << 18, 20
CONTEXTS, GATES = 4, 64
MAP_STEPS, MAP_SETS = 33, 16
#: Tasks whose counts are first added up together.
TOGETHER = 64
#: Numbers of one block of counts, and distinct words that a task holds before handing their counts on.
BLOCK, HELD_WORDS = 1 << 14, 500_000
RATE, START = 0.02, (1.0, 0.0, 0.0, 0.0)
#: Tokens whose bits are worked on at a time.
SLICE = 1 << 13
#: Tokens of a task's first step of learning.
FIRST_STEP = 8000
#: Steps of the mix a unit, and its largest value.
MIX_STEPS, MIX_MOST = 64, 12
#: The largest prediction of a slot, in the logistic domain.
STRETCH_MOST = 8.0
WAYS = 2 * MIX_STEPS * MIX_MOST + 1

_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position, then nodes and bits of all codes end to end."""
    n = len(weights)
    heap = [(max(1, w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = [0] * (2 * n), [0] * (2 * n)
    top = n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = top
        side[y] = 1
        heapq.heappush(heap, (a + b, top))
        top += 1
    root, first, nodes, bits = top - 1, [0], array("I"), bytearray()
    for k in range(n):
        path = []
        while k != root:
            path.append((parent[k] - n, side[k]))
            k = parent[k]
        for node, bit in reversed(path):
            nodes.append(node)
            bits.append(bit)
        first.append(len(nodes))
    return np.array(first, dtype=np.int64), np.array(nodes, dtype=np.uint32), np.frombuffer(bits, dtype=np.uint8).copy()


class Code:
    """Codes of words or bytes, with what a bit's contexts need worked out for each place."""

    def __init__(self, weights: list[int], kind: int, table_bits: int) -> None:
        self._set(*huffman(weights), kind, table_bits)

    def _set(self, first: np.ndarray, nodes: np.ndarray, bits: np.ndarray, kind: int, table_bits: int) -> None:
        self.first, self.nodes, self.bits, self.kind, self.table_bits = first, nodes, bits, kind, table_bits
        self.sizes = np.diff(first)
        depth = np.arange(len(nodes)) - np.repeat(first[:-1], self.sizes)
        #: By place: a hash of the node, and in the last four bits the depth up to 7 and the bit that comes.
        self.place = (nodes + np.uint32(1 + kind * 0x51ED27)) * _ODD[0] & np.uint32(0xFFFFFFF0)
        self.place |= (2 * np.minimum(depth, 7) + bits).astype(np.uint32)
        self.shift = np.uint32(32 - table_bits)

    def __getstate__(self):
        """What cannot be worked out again, so that broadcasts stay small."""
        return self.sizes.astype(np.uint8), self.nodes, np.packbits(self.bits), self.kind, self.table_bits

    def __setstate__(self, state) -> None:
        sizes, nodes, bits, kind, table_bits = state
        first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        self._set(first, nodes, np.unpackbits(bits, count=len(nodes)), kind, table_bits)

    def spread(self, symbols: np.ndarray, contexts: list[np.ndarray | None]) -> tuple:
        """Slots (a row for each context; None is the place alone), bits, rows of the
        final map, places' gates, and where each symbol's bits begin."""
        sizes = self.sizes[symbols]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.first[symbols] - starts, sizes)
        at += np.arange(len(at))
        place, slots = self.place.take(at), []
        last = (place & np.uint32(15)).astype(np.uint8)
        node = place & np.uint32(0xFFFFFFF0)
        for context in contexts:
            if context is None:
                mixed = node * _ODD[1]
            else:
                mixed = np.repeat(context, sizes)
                mixed ^= node
                mixed *= _ODD[2]
                mixed ^= mixed >> np.uint32(15)
                mixed *= _ODD[1]
            mixed >>= self.shift
            slots.append(mixed.astype(np.int64))
        way = last.astype(np.int32)
        way += 16 * self.kind
        way *= WAYS
        # the gate's part that a place decides: the kind, and whether three bits have come
        gate = (last >= 6).astype(np.uint8) << np.uint8(5)
        gate |= np.uint8(16 * self.kind)
        return slots, last & 1, way, gate, starts


@dataclass
class Codes:
    """Words with codes: numbers by word, counts, and the codes of words and bytes."""

    head: dict[bytes, int]
    counts: np.ndarray
    table_bits: int
    words: Code
    letters: Code

    @classmethod
    def build(cls, head: list[tuple[bytes, int]], total: int, table_bits: int, ends: int) -> Codes:
        """From the frequent words' counts, that of all words, and that of the end, which always has a code."""
        known = dict(head) | {END: ends}
        ordered = sorted(known.items(), key=lambda x: (-x[1], x[0]))
        counts = [c for _, c in ordered]
        letters = Counter(b for w, _ in ordered for b in w + END)
        return cls(
            {w: k for k, (w, _) in enumerate(ordered)},
            np.array(counts, dtype=np.int64),
            table_bits,
            Code([*counts, max(1, total - sum(counts))], 0, table_bits),
            Code([letters[b] + 1 for b in range(256)], 1, table_bits),
        )

    @property
    def escape(self) -> int:
        return len(self.head)


@dataclass
class Texts:
    """A batch of texts as word numbers end to end."""

    numbers: np.ndarray
    lengths: np.ndarray
    tail: list[bytes]

    def __post_init__(self) -> None:
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)

    @classmethod
    def of(cls, texts: list[str], codes: Codes) -> Texts:
        tokens, lengths = [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = words_of(text)
            own.append(END)
            lengths[k] = len(own)
            tokens += own
        numbers = np.fromiter(map(codes.head.get, tokens, repeat(codes.escape)), dtype=np.int64, count=len(tokens))
        return cls(numbers, lengths, [tokens[k] for k in np.flatnonzero(numbers == codes.escape).tolist()])

    def hashes(self, escape: int) -> np.ndarray:
        """A 64-bit number of each word: of coded words by their numbers, of others by their bytes."""
        out = lm_passages.mix(self.numbers.astype(np.uint64) + np.uint64(1))
        out[self.numbers == escape] = np.fromiter(map(xxhash.xxh64_intdigest, self.tail), dtype=np.uint64, count=len(self.tail))
        return out


def bits_of(texts: Texts, codes: Codes) -> Iterator[tuple]:
    """In slices: slots, bits, rows of the final map, where each symbol begins, the
    symbols' tokens (first number, or one for each), and the places' gates."""
    numbers = texts.numbers.astype(np.uint32) + np.uint32(1)
    begins = np.concatenate(([True], texts.owner[1:] != texts.owner[:-1])) if len(numbers) else np.zeros(0, dtype=bool)
    before = np.concatenate((np.zeros(1, dtype=np.uint32), numbers[:-1]))
    before[begins] = 0
    second = np.concatenate((np.zeros(1, dtype=np.uint32), before[:-1]))
    second[begins] = 0
    for k in range(0, len(numbers), SLICE):
        own = slice(k, k + SLICE)
        one = before[own] * _ODD[3]
        contexts = [None, one, (one + np.uint32(7)) ^ (second[own] * _ODD[4]), second[own] * _ODD[1] + np.uint32(3)]
        slots, bits, way, gate, starts = codes.words.spread(texts.numbers[own], contexts)
        yield slots, bits, way, starts, np.arange(k, k + len(starts)), gate
    if texts.tail:
        spelled = np.frombuffer(END.join(texts.tail) + END, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts.tail), dtype=np.int64, count=len(texts.tail)) + 1
        token = np.repeat(np.flatnonzero(texts.numbers == codes.escape), sizes)
        past = [np.concatenate((np.full(k, 10, dtype=np.uint32), spelled[:-k].astype(np.uint32)))[: len(spelled)] for k in (1, 2, 3)]
        past[1][past[0] == 10] = 10
        past[2][past[1] == 10] = 10
        for k in range(0, len(spelled), 2 * SLICE):
            own = slice(k, k + 2 * SLICE)
            a, b, c = (x[own] for x in past)
            contexts = [a * _ODD[3], (a | b << np.uint32(8)) * _ODD[4], (a | b << np.uint32(8) | c << np.uint32(16)) * _ODD[1], None]
            slots, bits, way, gate, starts = codes.letters.spread(spelled[own].astype(np.int64), contexts)
            yield slots, bits, way, starts, token[own], gate


def evidence(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """By slot, in a byte: six bits of the prediction in the logistic domain, two of how much was seen."""
    stretched = np.log((ones + np.float32(0.4)) / (total - ones + np.float32(0.4)), dtype=np.float32)
    steps = np.rint(np.clip(stretched, -STRETCH_MOST, STRETCH_MOST) * np.float32(31 / STRETCH_MOST)).astype(np.int8) + np.int8(32)
    level = (total > 0).astype(np.uint8) + (total > 2) + (total > 15)
    return steps.astype(np.uint8) << np.uint8(2) | level.astype(np.uint8)


def first_weights() -> np.ndarray:
    """The code's place alone for words, two bytes before for spelling."""
    weights = np.repeat(np.array(START, dtype=np.float32)[:, None], GATES, axis=1)
    spelling = np.arange(GATES) & 16 > 0
    weights[:, spelling] = np.array([[0.3], [0.5], [0.2], [0.0]], dtype=np.float32)
    return weights


_STRETCH = (((np.arange(256) >> 2) - 32) * (STRETCH_MOST / 31)).astype(np.float32)


def parts_of(weights: np.ndarray) -> list[np.ndarray]:
    """By context: what a gate and a byte of evidence add to the mix."""
    return [(weights[k][:, None] * _STRETCH[None, :]).astype(np.float32).ravel() for k in range(CONTEXTS)]


def mixed(slots, gate: np.ndarray, known: np.ndarray, parts: list[np.ndarray]):
    """Rows of gate and evidence by context, gates, and the mix in steps, as indexes of the final map's rows."""
    seen = [known[k].take(row, mode="clip") for k, row in enumerate(slots)]
    gates = (seen[2] & 3) << 2
    gates |= seen[1] & 3
    gates |= gate
    high, rows, total = gates.astype(np.int64) << 8, [], None
    for k in range(CONTEXTS):
        row = high | seen[k]
        rows.append(row)
        part = parts[k].take(row, mode="clip")
        total = part if total is None else np.add(total, part, out=total)
    np.clip(total, -MIX_MOST, MIX_MOST, out=total)
    total *= np.float32(MIX_STEPS)
    total += np.float32(MIX_STEPS * MIX_MOST + 0.5)
    return rows, gates, total.astype(np.int32)


def _chances() -> np.ndarray:
    """The chance of a one at each step of the mix."""
    return 1 / (1 + np.exp(-(np.arange(WAYS) / MIX_STEPS - MIX_MOST)))


_CHANCE = _chances().astype(np.float32)
#: The map's step of each step of the mix.
_CELL = np.clip(np.rint((np.arange(WAYS) / MIX_STEPS - MIX_MOST) * (MAP_STEPS - 1) / 16 + (MAP_STEPS - 1) / 2), 0, MAP_STEPS - 1).astype(np.int64)


@dataclass
class Model:
    """What scoring needs: each slot's evidence, weights, and the final map (by set, bit that comes, step of the mix)."""

    slots: np.ndarray
    weights: np.ndarray
    final: np.ndarray

    @classmethod
    def of(cls, total: np.ndarray, ones: np.ndarray, weights: np.ndarray, seen: np.ndarray, came: np.ndarray) -> Model:
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, MAP_STEPS)))
        refined = ((came + 8 * centre) / (seen + 8)).astype(np.float32)
        one = (_CHANCE[None, :] + refined[:, _CELL]) / 2
        return cls(evidence(total, ones), weights.astype(np.float32), np.stack((1 - one, one), axis=1).ravel())


def costs(texts: Texts, codes: Codes, model: Model) -> np.ndarray:
    """Bits of each token."""
    out, parts = np.zeros(len(texts.numbers)), parts_of(model.weights)
    for slots, _, way, starts, token, gate in bits_of(texts, codes):
        _, _, at = mixed(slots, gate, model.slots, parts)
        at += way
        chances = np.multiply.reduceat(model.final.take(at, mode="clip").astype(np.float64), starts)
        bits = -np.log2(chances)
        if len(token) and len(token) == token[-1] - token[0] + 1:  # a symbol each
            out[token[0] : token[-1] + 1] += bits
        else:
            out += np.bincount(token, weights=bits, minlength=len(out))
    return out


class Learner:
    """One task's counts, weights and map."""

    def __init__(self, codes: Codes) -> None:
        size = 1 << codes.table_bits
        self.codes = codes
        self.counts = np.zeros((CONTEXTS, 2 * size), dtype=np.uint32)
        self.weights = first_weights()
        self.weighed = np.zeros(GATES)
        #: By set, bit that came and step of the mix.
        self.came = np.zeros(2 * MAP_SETS * WAYS, dtype=np.int64)
        self.tokens = 0
        self.evident = evidence(*self._tables())

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Totals and ones of all slots."""
        pairs = self.counts.reshape(CONTEXTS, -1, 2)
        return (pairs[:, :, 0] + pairs[:, :, 1]).astype(np.float32), pairs[:, :, 1].astype(np.float32)

    def learn_all(self, texts: list[str]) -> None:
        """Learn in steps of half of what has been seen, so that a short partition teaches too."""
        start = 0
        while start < len(texts):
            stop, room = start, max(FIRST_STEP, self.tokens // 2)
            while stop < len(texts) and room > 0:
                room -= len(texts[stop]) // 6 + 1
                stop += 1
            step = Texts.of(texts[start:stop], self.codes)
            self.learn(step)
            self.tokens += len(step.numbers)
            start = stop

    def learn(self, texts: Texts) -> None:
        parts = parts_of(self.weights)
        for slots, bits, way, _, _, gate in bits_of(texts, self.codes):
            rows, gates, at = mixed(slots, gate, self.evident, parts)
            error = (bits - _CHANCE.take(at, mode="clip")).astype(np.float64)
            hits = np.bincount(gates, minlength=GATES)
            rate = RATE * np.sqrt(np.minimum(hits, 400)) / np.maximum(hits, 1)
            for k in range(CONTEXTS):
                by_byte = np.bincount(rows[k], weights=error, minlength=256 * GATES).reshape(GATES, 256)
                self.weights[k] += rate * (by_byte @ _STRETCH)
            parts = parts_of(self.weights)
            self.weighed += hits
            at += way
            np.add.at(self.came, at, 1)
            for k, row in enumerate(slots):
                row *= 2
                row += bits
                np.add.at(self.counts[k], row, np.uint32(1))
        # predictions follow the counts at the end of each step
        for k in range(CONTEXTS):
            ones = self.counts[k][1::2].astype(np.float32)
            self.evident[k] = evidence(self.counts[k][::2].astype(np.float32) + ones, ones)

    def map_counts(self) -> np.ndarray:
        """By set and step of the map: bits seen, then ones among them."""
        came = self.came.reshape(MAP_SETS, 2, WAYS)
        by_step = np.stack([[np.bincount(_CELL, weights=came[s, b], minlength=MAP_STEPS) for b in range(2)] for s in range(MAP_SETS)])
        return np.concatenate((by_step.sum(axis=1).ravel(), by_step[:, 1].ravel()))

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks to be added up: key, numbers."""
        yield -1, np.concatenate(((self.weights * self.weighed).ravel(), self.weighed))
        yield -2, self.map_counts()
        flat = self.counts.ravel()
        for key, k in enumerate(range(0, len(flat), BLOCK)):
            part = flat[k : k + BLOCK]
            if part.any():
                yield key, part.astype(np.float64)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: whole numbers below 2**32 in four bytes, others in eight."""
    whole = bool(np.all(values == np.floor(values)) and np.all(values < 2**32) and np.all(values >= 0))
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if whole else values.astype("<f8").tobytes()
    return (b"w" if whole else b"f") + zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    if data[:1] == b"f":
        return np.frombuffer(raw, dtype="<f8")
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.float64)


def _head(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above the least count that at most ``most`` words have.

    Words met once are left out: spelling them teaches how new words are spelled,
    and their share is that of new words to come.
    """
    counts = counts.filter("c > 1")
    step = F.floor(F.log2("c") * 16).cast("int")
    rows, chosen, least = dict(counts.groupBy(step.alias("s")).count().collect()), 0, None
    for s in sorted(rows, reverse=True):
        if chosen + rows[s] > most:
            break
        chosen, least = chosen + rows[s], s
    return [] if least is None else [(bytes(w), c) for w, c in counts.filter(step >= least).select("word", "c").collect()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for text in texts:
            held.update(words_of(text))
        held[END] += len(texts)
        if len(held) >= HELD_WORDS:
            yield out()
    if held:
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts; the end is a word of its own."""
    counted = training.select("__text").mapInArrow(_count_words, "word binary, n long")
    return staged(counted.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")


def _learn(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for batch in batches:
            learner = learner or Learner(shared.value)
            learner.learn_all(batch.column(0).to_pylist())
        at = TaskContext.get()
        salt = at.partitionId() if at else 0
        for key, values in learner.rows() if learner else ():
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([salt], pa.int32()), pa.array([_pack(values)], pa.binary())], names=["key", "salt", "data"])

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for data in rows["data"]:
        total = total + _unpack(data)
    return pd.DataFrame({"key": rows["key"][:1], "salt": rows["salt"][:1], "data": [_pack(total)]})


def train(training: DataFrame, codes: Codes, shared) -> Model:
    """A model from all training texts; ``shared`` is the broadcast of the codes.

    Tasks' blocks are added up ``TOGETHER`` at a time, level by level.
    """
    shape = "key int, salt int, data binary"
    added = training.select("__text").mapInArrow(_learn(shared), shape)
    groups = training.rdd.getNumPartitions()
    while groups > 1:
        added = added.withColumn("salt", F.floor(F.col("salt") / TOGETHER).cast("int")).groupBy("key", "salt").applyInPandas(_add, shape)
        groups = -(-groups // TOGETHER)
    size = CONTEXTS << codes.table_bits
    both, weights, seen = np.zeros(2 * size, dtype=np.float32), first_weights(), np.zeros(2 * MAP_SETS * MAP_STEPS)
    for key, _, data in added.collect():  # a row for each block of tables of fixed size
        values = _unpack(bytes(data))
        if key == -1:
            behind = values[CONTEXTS * GATES :]
            found = values[: CONTEXTS * GATES].reshape(CONTEXTS, GATES)
            weights = np.where(behind > 0, found / np.maximum(behind, 1), weights)
        elif key == -2:
            seen = values
        else:
            both[key * BLOCK : key * BLOCK + len(values)] = values
    tables = both.reshape(CONTEXTS, -1, 2)
    seen = seen.reshape(2, MAP_SETS, MAP_STEPS)
    return Model.of(tables[:, :, 0] + tables[:, :, 1], np.ascontiguousarray(tables[:, :, 1]), weights, seen[0], seen[1])


_PASSAGE = T.StructType([*[T.StructField(n, T.LongType()) for n in ("context", "passage", "times")], T.StructField("bits", T.DoubleType())])


def _score(shared, learned, schema: pa.Schema):
    inner = schema.field("__passages").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = shared.value, learned.value
        logs, known = np.append(np.log10(codes.counts + 1.0), 0.0), np.append(codes.counts > 0, False)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            own, n = Texts.of(texts, codes), len(texts)
            add = lambda values, own=own, n=n: np.bincount(own.owner, weights=values[own.numbers], minlength=n)
            bits, tails, times = costs(own, codes, model), [], []
            cuts = np.searchsorted(own.owner[own.numbers == codes.escape], np.arange(n + 1)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                words = Counter(own.tail[a:b])
                tails.append(list(words))
                times.append(list(words.values()))
            first, last, context, whole = lm_passages.passages(own.hashes(codes.escape), own.owner)
            sums = np.concatenate(([0.0], np.cumsum(bits)))
            text, *found = lm_passages.by_document(own.owner[first], context, whole, sums[last] - sums[first])
            columns = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in found]
            passages = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(inner)))
            made = [
                pa.array(own.lengths, pa.int64()),
                pa.array(add(known).astype(np.int64), pa.int64()),
                pa.array(add(logs), pa.float64()),
                pa.array(np.bincount(own.owner, weights=bits, minlength=n), pa.float64()),
                pa.array([len(x.encode()) for x in texts], pa.int64()),
                pa.array(tails, pa.list_(pa.binary())),
                pa.array(times, pa.list_(pa.int64())),
                passages,
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], *made], schema=schema)

    return run


#: The columns that scoring adds.
ADDED = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def score(
    documents: DataFrame,
    held_out,
    carry: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    head: int = HEAD,
    table_bits: int = TABLE_BITS,
) -> DataFrame:
    """A row per document: the carried columns, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (log10 under smoothed word
    counts), ``score`` (log10 under the model) and ``bits_per_byte``.

    ``held_out`` is a boolean Column; where it is true (or null) a document is not
    learned from.  A training document is coded with the passages of all other
    training documents, so that its score can be compared with that of a held-out
    one; ``base_score`` counts it in.  A null text is an empty one: its end
    is its only token.  With nothing to learn from, every word is spelled.  Repeated
    rows count as often as they occur.  Columns that are not named are not read; a
    carried column may not have the name of an added one or begin with two
    underscores (``ValueError``).
    """
    refuse_clash(carry, ADDED)
    spark = documents.sparkSession
    small_batches(spark)
    held = F.coalesce(held_out, F.lit(True)).alias("__held")
    rows = documents.select(*[documents[c] for c in carry], held, text_of(documents, text_column).alias("__text"))
    training = rows.filter(~F.col("__held"))
    counts = word_counts(training)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bits = min(table_bits, max(14, int(total * 4).bit_length()))
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    codes = Codes.build(_head(counts, head), total, bits, ends)
    shared = spark.sparkContext.broadcast(codes)
    model = spark.sparkContext.broadcast(train(training, codes, shared))
    schema = T.StructType(
        [T.StructField(c, documents.schema[c].dataType) for c in carry]
        + [T.StructField("__held", T.BooleanType()), T.StructField("__row", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("__tokens", "__known")]
        + [T.StructField(n, T.DoubleType()) for n in ("__logs", "__bits")]
        + [T.StructField("__bytes", T.LongType()), T.StructField("__tail", T.ArrayType(T.BinaryType())), T.StructField("__times", T.ArrayType(T.LongType()))]
        + [T.StructField("__passages", T.ArrayType(_PASSAGE))]
    )
    numbered = rows.select(*carry, "__held", F.monotonically_increasing_id().alias("__row"), "__text")
    scored = staged(numbered.mapInArrow(_score(shared, model, to_arrow_schema(schema)), schema), "lm-scored")
    # words without codes: their counts come by a join; none of them is frequent
    tails = scored.select("__row", F.explode(F.arrays_zip("__tail", "__times")).alias("t")).select("__row", F.col("t.__tail").alias("word"), F.col("t.__times").alias("n"))
    met = tails.join(counts.hint("merge"), "word").groupBy("__row").agg(F.sum("n").alias("__more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("__more_logs"))
    changed = lm_passages.coded(scored.select(F.col("__row").alias("row"), F.col("__held").alias("held"), F.explode("__passages").alias("p")).select("row", "held", "p.*"))
    changed = changed.select(F.col("row").alias("__row"), F.col("bits").alias("__change"))
    out = scored.drop("__tail", "__times", "__passages").join(met.hint("merge"), "__row", "left").join(changed.hint("merge"), "__row", "left")
    out = out.withColumn("__bits", F.col("__bits") + F.coalesce("__change", F.lit(0.0)))
    below = float(np.log10(total + 1.0 * (distinct + 1)))
    return out.select(
        *carry,
        F.col("__held").alias("held_out"),
        F.col("__tokens").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__logs") + F.coalesce("__more_logs", F.lit(0.0)) - F.col("__tokens") * below).alias("base_score"),
        (-F.col("__bits") * float(np.log10(2))).alias("score"),
        F.when(F.col("__bytes") > 0, F.col("__bits") / F.col("__bytes")).alias("bits_per_byte"),
    )
