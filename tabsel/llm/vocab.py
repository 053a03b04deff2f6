"""Public vocabularies, read once in each Python worker. Their folder is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

TOKENIZERS = "/opt/tokenizers"
#: Pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(name: str, folder: str = TOKENIZERS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


@lru_cache(maxsize=2)
def covered_chars(name: str, folder: str = TOKENIZERS) -> np.ndarray:
    """Which code points have a piece of their own in a vocabulary with byte fallback; the others are spelled as bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    table = np.zeros(0x110000, bool)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if len(piece) == 1 and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            table[ord(piece)] = True
    table[ord(" ")] = True  # written as the piece for a space
    return table


def id_type(name: str, folder: str = TOKENIZERS, *more: int) -> type[np.unsignedinteger]:
    """The narrowest of uint16 and uint32 that holds every id of a vocabulary, and the numbers `more`."""
    return np.uint16 if max(encoding(name, folder).max_token_value, *more, 0) < 1 << 16 else np.uint32
