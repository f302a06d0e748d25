"""Vectorised hashing of bytes, words and windows with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_RANDOM = np.random.default_rng(20240607)
BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_BYTE = np.zeros(256, bool)
for _c in range(256):
    ALNUM_BYTE[_c] = _c >= 0x80 or chr(_c).isalnum() or chr(_c) == "_"
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32
#: Bytes of a word up to which span() hashes it. Sums of powers modulo 2**64 are the same for some long texts that differ
#: (patterns in which every half repeats the other one inverted), so longer words take a cryptographic hash.
SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values; changes x."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(which: str, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _POWERS[which] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[which][:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() reads the hash of any span."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers("up", len(codes)) if len(codes) else codes, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of codes[start:end]: equal spans have equal hashes wherever they lie."""
    if not len(start):
        return np.empty(0, np.uint64)
    out = sums[end] - sums[start]
    out *= _powers("down", len(sums))[start]
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a line feed behind each as one byte array, and the offset of each text (and of the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def words_of(texts: list[bytes], is_word: np.ndarray = WORD_BYTE, lower: bool = False):
    """(hash of each word, first word of each text (and of the end), starts, ends) over joined(texts).

    The hash of a word is the same wherever it lies, whatever its length.
    """
    data, offsets = joined(texts)
    if lower:
        data = LOWER_BYTE[data]
    starts, ends = word_spans(data, is_word)
    hashes = span(prefix(BYTE_CODES[data]), starts, ends)
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, offsets), starts, ends


def blocks(items, size, limit: int):
    """Lists of consecutive items whose sizes add up to about limit."""
    block, total = [], 0
    for x in items:
        block.append(x)
        total += size(x)
        if total >= limit:
            yield block
            block, total = [], 0
    if block:
        yield block
