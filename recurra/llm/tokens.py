"""Byte-level BPE ids in executor tasks. Vocabulary files are named by path and read once per worker."""

from __future__ import annotations

import base64
import functools

import numpy as np

# Fixed values of the public vocabulary: its one added token, which its file matches inside texts as well.
ADDED_TOKEN, ADDED_ID = "<|endoftext|>", 50256


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def byte_encoder(ranks_path: str):
    """Encoder over a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encode(text: str, encoder) -> list[int]:
    """Ids of one whole text; the added token's string is its id, as in the vocabulary's own file."""
    if ADDED_TOKEN not in text:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for k, part in enumerate(text.split(ADDED_TOKEN)):
        if k:
            ids.append(ADDED_ID)
        ids += encoder.encode_ordinary(part)
    return ids


def id_array(text: str | None, encoder, *tail: int) -> np.ndarray:
    """Ids as little-endian 32-bit integers; no text counts as an empty one."""
    return np.array(encode(text or "", encoder) + list(tail), dtype="<u4")
