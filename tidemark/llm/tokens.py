"""A byte-level BPE encoder for workers, loaded once per Python process.

The vocabulary files are parameters and are read where they lie.  Ids are those of
the ``tokenizers`` file with its default settings (a special token's text is that
token).  Encoding goes through ``tiktoken`` with the same merges, which is several
times faster; ids were compared over every code point and over random texts
(tests/llm).  Its pattern engine gives up on very long runs, such as a million
blanks; such a text goes to the ``tokenizers`` file itself.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The special token of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def whole_encoder(vocabulary: str):
    """The ``tokenizers`` file that lies beside the ranks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.rsplit(".", 1)[0] + ".json")


def encode(text: str, vocabulary: str, pattern: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers."""
    try:
        return np.asarray(encoder(vocabulary, pattern).encode_to_numpy(text, allowed_special="all"), dtype="<u4")
    except ValueError:  # a run too long for the pattern engine
        return np.asarray(whole_encoder(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
