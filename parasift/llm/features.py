"""Hashed word features of many texts at once: rolling hashes over a chunk's bytes, no word strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BITS = 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


#: Powers for stretches of so many bytes stay in a worker; those for a longer text are made anew.
KEPT_POWERS = 1 << 20


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _kept_powers() if size <= KEPT_POWERS else _new_powers(size)


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(KEPT_POWERS)


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of a chunk of texts: where they begin and end, and their text's index."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        inside = is_word[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)  # the last byte is never inside a word
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.texts = len(texts)
        self.counts = np.bincount(self.text, minlength=len(texts))

    def rolling(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64, out=sums[1:])
        return sums, inverse

    @staticmethod
    def span(rolled: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        sums, inverse = rolled
        return (sums[stop] - sums[start]) * inverse[start]


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    x = (values + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
    x ^= x >> np.uint64(32)
    return x * _MIX


def slot(values: np.ndarray, salt: int, bits: int = BITS) -> np.ndarray:
    return (mixed(values, salt) >> np.uint64(64 - bits)).astype(np.int64)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes, or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held
