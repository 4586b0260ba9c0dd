"""Hashes of all tokens of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_SALT = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte classes: 0 separates; a token is a run of one other class.
SPACES = np.ones(256, np.uint8)
SPACES[[32, *range(9, 14)]] = 0
WORDS_AND_MARKS = np.where(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]), 1, 2).astype(np.uint8)
WORDS_AND_MARKS[[32, *range(9, 14)]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def token_hashes(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each token's bytes, with its first byte's place and its class."""
    raw = np.frombuffer(data, np.uint8)
    kind = classes[raw]
    edges = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    edges = np.append(edges, len(raw)) if len(edges) and edges[-1] != len(raw) else edges
    if len(edges) < 2:
        empty = np.empty(0, np.uint64)
        return empty, empty.astype(np.int64), empty.astype(np.uint8)
    starts, ends = edges[:-1], edges[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SALT[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts, kind[starts]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words; of fewer words: one of them all; of none: none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        acc = np.uint64(n)
        for w in words:
            acc = mix(np.array([acc], np.uint64) * _BASE + w)[0]
        return np.array([acc], np.uint64)
    acc = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        acc = mix(acc * _BASE + words[k : n - width + 1 + k])
    return acc
