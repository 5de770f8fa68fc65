"""Byte-level BPE ids from a public vocabulary file."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np


def default_vocabulary() -> str:
    """Path of the public 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed values of the format: the printable bytes stand for themselves in a byte-level vocabulary, the rest follow from 256 on.
_PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(r"\s\s")


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = True):
    """text -> ids as the vocabulary file's own tokenizer gives them; none is put around a text.

    Where a text holds an added token literally it is taken for ordinary text, or, with ``added``, gives the token's id
    as the file's tokenizer does by default.

    The vocabulary is read from the tokenizers file and run by a faster engine. The pattern's look-ahead only matters
    where white space runs, so texts without such runs take the pattern without it.
    """
    import tiktoken

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in _PRINTABLE]
    byte |= {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    whole = tiktoken.Encoding("whole", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = tiktoken.Encoding("plain", pat_str=_PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return (whole if _SPACES.search(text) else plain).encode_ordinary(text)

    if not added:
        return encode
    named = {t["content"]: t["id"] for t in model["added_tokens"]}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + ")") if named else None

    def encode_added(text: str) -> list[int]:
        if cut is None or not cut.search(text):
            return encode(text)
        ids = []
        for i, piece in enumerate(cut.split(text)):  # every second piece is an added token
            ids += [named[piece]] if i % 2 else encode(piece)
        return ids

    return encode_added


def ids_of(encode, text: str | None, end: int) -> np.ndarray:
    """A text's ids and the end id, as little-endian unsigned 32-bit integers; a null text has the end id alone."""
    ids = encode(text) if text else []
    ids.append(end)
    return np.array(ids, "<u4")
