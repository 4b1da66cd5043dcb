"""Line-first quality rules.

Every line is judged by itself; lines that fail are removed; a document that
loses too much of its text with them is rejected.  Whole-document counts
(words, symbols, repeated lines, repeated passages) are taken from the text as
it came, and a document with too few words or too many repeated ones fails at
once.

A line with a word in it fails when it is

* symbols: more than 15 % of its visible characters are ``#*$%&|<>{}~^=_\\``;
* navigation: three or more separators that cut it into pieces of at most
  three words;
* punctuation: emphatic marks (``!`` or ``?``) on more than 40 % of its words;
* boilerplate: at most 25 words with one of the fixed phrases below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import refuse_clash, small_batches, text_of

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A document that loses more than this share of its words with failed lines is rejected.
MAX_LOST = 0.5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_LINE_SYMBOLS = re.compile(r"[#*$%&|<>{}~^=_\\]")
_SEPARATOR = re.compile(r"\||»|›|·|•|::| > | / ")
#: A line without any of these can only fail as boilerplate.
_MARKS = re.compile(r"[#*$%&|<>{}~^=_\\\\»›·•:/!?]")
_BOILERPLATE = re.compile(
    r"all rights reserved|copyright (?:\(c\)|©)|©|privacy policy|terms of (?:use|service)|cookie policy"
    r"|accept (?:all )?cookies|uses cookies|subscribe to our|sign up for our|click here|read more|share this"
    r"|skip to (?:main )?content|back to top|powered by|log ?in / |lorem ipsum|javascript (?:is|must be) ",
    re.IGNORECASE,
)
#: Odd multipliers for the places of a window.
_PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) | 1 for k in range(WINDOW)], dtype=np.uint64)


def line_fails(line: str, n_words: int) -> str | None:
    """The rule that a line with words fails, or None."""
    if not _MARKS.search(line):
        return "boilerplate" if n_words <= 25 and _BOILERPLATE.search(line) else None
    visible = len(line) - line.count(" ")
    if len(_LINE_SYMBOLS.findall(line)) > 0.15 * visible:
        pieces = [x for x in _SEPARATOR.split(line) if x.strip()]
        return "navigation" if len(pieces) >= 4 and n_words <= 4 * len(pieces) else "symbols"
    cuts = _SEPARATOR.findall(line)
    if len(cuts) >= 3 and n_words - len(cuts) <= 3 * (len(cuts) + 1):
        return "navigation"
    if n_words >= 3 and sum(x[-1] in "!?" for x in line.replace(",", "").split()) > 0.4 * n_words:
        return "punctuation"
    if n_words <= 25 and _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts laid end to end: how many words lie in a window of ``window``
    words that its own text has at least twice."""
    total, bounds = len(hashes), np.concatenate(([0], np.cumsum(lengths)))
    out = np.zeros(len(lengths), dtype=np.int64)
    if total < window:
        return out
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    starts = total - window + 1
    keys = np.zeros(starts, dtype=np.uint64)
    for k in range(window):
        keys += hashes[k : k + starts] * _PLACES[k]
    inside = owner[:starts] == owner[window - 1 :]
    keys = keys ^ (keys >> np.uint64(29))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9) + owner[:starts] * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(inside)
    order = at[np.argsort(keys[at], kind="stable")]
    if not len(order):
        return out
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    steps = np.zeros(total + 1, dtype=np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))
    return covered[bounds[1:]] - covered[bounds[:-1]]


def clean_lines(text: str) -> tuple[str, int, int, int, int]:
    """The text without its failed lines, words in them, lines, failed lines,
    and lines equal to an earlier one."""
    lines = text.split("\n")
    kept, lost, failed, seen, wordy = [], 0, 0, set(), 0
    for line in lines:
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n:
            wordy += 1
            seen.add(line)
            if line_fails(line, n):
                lost += n
                failed += 1
                continue
        kept.append(line)
    return ("\n".join(kept) if failed else text), lost, len(lines), failed, wordy - len(seen)


def _judge(schema: pa.Schema, max_lost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            words, lengths = [], np.zeros(len(texts), dtype=np.int64)
            for k, text in enumerate(texts):
                own = text.encode().split()
                lengths[k] = len(own)
                words.extend(own)
            hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
            repeats = repeated_words(hashes, lengths)
            lines = [clean_lines(x) for x in texts]
            lost = np.array([x[1] for x in lines], dtype=np.int64)
            base = (lengths < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * lengths)
            columns = {
                "n_words": lengths,
                "word_chars": [len(x) - sum(map(x.count, _BLANKS)) for x in texts],
                "n_symbols": [sum(map(x.count, _SYMBOLS)) for x in texts],
                "n_dup_lines": [x[4] for x in lines],
                "n_repeat_words": repeats,
                "n_lines": [x[2] for x in lines],
                "n_failed_lines": [x[3] for x in lines],
                "n_lost_words": lost,
                "base_failed": base,
                "kept": ~base & (lost <= max_lost * lengths),
                "clean_text": [x[0] for x in lines],
            }
            given = [batch.column(k) for k in range(batch.num_columns - 1)]
            made = [pa.array(columns[f.name], f.type) for f in list(schema)[len(given) :]]
            yield pa.record_batch([*given, *made], schema=schema)

    return run


_MADE = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "n_lost_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
]


def judge(
    documents: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    max_lost: float = MAX_LOST,
    with_text: bool = True,
) -> DataFrame:
    """A row per document: the carried columns, counts, ``base_failed``,
    ``kept`` and (``with_text``) ``clean_text``, the text without failed lines.

    ``n_repeat_words`` compares windows by 64-bit hashes.  A null text has no
    words and fails for having too few, as an empty one does.  Repeated rows
    and null ids are judged row by row.  Only the carried columns and the text
    are read; a carried column may not have the name of a made one or begin with
    two underscores (``ValueError``).
    """
    refuse_clash(carry, [f.name for f in _MADE])
    small_batches(documents.sparkSession)
    made = _MADE if with_text else _MADE[:-1]
    schema = T.StructType([documents.schema[c] for c in carry] + made)
    slim = documents.select(*[documents[c] for c in carry], text_of(documents, text_column).alias("__text"))
    return slim.mapInArrow(_judge(to_arrow_schema(schema), max_lost), schema)
