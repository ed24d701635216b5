"""Array kernels for texts: words and word shingles as 64-bit hashes, without a Python object per word.

All arithmetic is modulo 2**64. A word's hash is a polynomial over random values of its bytes, mixed at the end; a
shingle's hash combines the hashes of its words. Memory is bounded by the text in hand: bytes are hashed in pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
SEED = 20_240_229


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_randoms(n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values with A-Z as a-z, powers of an odd base, and their inverses."""
    values = np.random.default_rng(SEED + 1).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    base = int(odd_randoms(1)[0])
    inverse = pow(base, -1, 1 << 64)
    out = []
    for step in (base, inverse):
        powers = np.full(PIECE, step, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return values, *out


def byte_classes(words: bytes) -> np.ndarray:
    """Table of the bytes that belong to words."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(words, dtype=np.uint8)] = True
    return out


# Everything but the blank and the controls from tab to carriage return.
NOT_SPACE = byte_classes(bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13))
# Letters, digits and every byte of a character beyond ASCII.
ALPHANUMERIC = byte_classes(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))


def _piece_hashes(
    data: np.ndarray, member: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    values, powers, inverses = tables()
    inside = member[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts = edges[inside[edges]]
    ends = edges[~inside[edges]]
    if len(inside) and inside[0]:
        starts = np.concatenate(([0], starts))
    if len(inside) and inside[-1]:
        ends = np.concatenate((ends, [len(data)]))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverses[starts]
    heads = []
    for size in prefixes:
        longer = starts[ends - starts > size]
        heads.append(mix((sums[longer + size] - sums[longer]) * inverses[longer] + np.uint64(size << 32)))
    return mix(raw + (ends - starts).astype(np.uint64)), starts, heads


def _long_word(data: np.ndarray) -> np.ndarray:
    """Hash of one word longer than a piece: its pieces' hashes, combined in order."""
    parts = [_piece_hashes(data[k : k + PIECE], np.ones(256, dtype=bool))[0] for k in range(0, len(data), PIECE)]
    state = np.zeros(1, dtype=np.uint64)
    for part in parts:
        state = mix(state * np.uint64(3) + part)
    return state


def prefix_hashes(data: np.ndarray, member: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the first bytes, as many as each size says, of the words that are longer. Order is lost."""
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        gaps = np.flatnonzero(~member[data[at:end]]) if end < len(data) else ()
        end = at + int(gaps[-1]) + 1 if len(gaps) else end
        out += _piece_hashes(data[at:end], member, sizes)[2]
        at = end
    return np.concatenate(out)


def word_hashes(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words (runs of member bytes) of UTF-8 bytes, with A-Z read as a-z."""
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            gaps = np.flatnonzero(~member[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word that fills the piece
                stop = end
                while stop < n and member[data[stop : stop + PIECE]].all():
                    stop += PIECE
                rest = np.flatnonzero(~member[data[stop : stop + PIECE]])
                end = stop + int(rest[0]) if len(rest) else n
                hashes.append(_long_word(data[at:end]))
                starts.append(np.array([at]))
                at = end
                continue
        found, where, _ = _piece_hashes(data[at:end], member)
        hashes.append(found)
        starts.append(where + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def packed(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts, joined by blanks, of about `most` bytes: (first, last + 1, bytes, byte offsets of the texts)."""
    first, parts, size = 0, [], 0
    for k, text in enumerate(texts):
        part = (text or "").encode("utf-8", "replace") + b" "
        if parts and size + len(part) > most:
            yield first, k, *_joined(parts)
            first, parts, size = k, [], 0
        parts.append(part)
        size += len(part)
    if parts:
        yield first, len(texts), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), offsets


def words_by_text(texts: list[str | None], member: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order of its words."""
    for first, last, data, offsets in packed(texts):
        hashes, starts = word_hashes(data, member)
        bounds = np.searchsorted(starts, offsets)
        for k in range(last - first):
            yield hashes[bounds[k] : bounds[k + 1]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    factors = odd_randoms(size + 1, SEED + 2)
    out = words[: n - width + 1] * factors[0]
    for k in range(1, width):
        out += words[k : n - width + 1 + k] * factors[k]
    return np.unique(mix(out + factors[size : size + 1] * np.uint64(width)))
