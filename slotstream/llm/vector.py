"""Whole texts as numpy arrays: words, 64-bit word hashes and rolling hashes, with no loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(int(_P), -1, 1 << 64))

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def lowered() -> np.ndarray:
    """Byte to byte with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum() -> np.ndarray:
    """Word bytes of the decontamination contract after lowering: 0-9, a-z and every byte over 0x7F."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


@lru_cache(maxsize=4)
def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte (of its lower-case form if ``lower``)."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    return values[lowered()] if lower else values


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 at least of the base and of its inverse modulo 2**64; only the longest tables are kept."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up, down = np.full(size, _P, U64), np.full(size, _P_INV, U64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Packed:
    """Texts joined with a separator byte that is no word byte; ``start``/``stop`` bound each text."""

    def __init__(self, texts: list[bytes | None], sep: bytes):
        parts = [x or b"" for x in texts]
        size = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        self.buf = np.frombuffer(sep.join(parts) + sep, np.uint8)
        self.stop = np.cumsum(size + 1) - 1
        self.start = self.stop - size
        self.n = len(parts)


class Words:
    """Words of packed texts: ``start``/``stop`` in bytes, ``first[d]:first[d+1]`` the words of text d."""

    def __init__(self, packed: Packed, is_word: np.ndarray):
        flags = np.zeros(len(packed.buf) + 1, np.int8)
        flags[:-1] = is_word[packed.buf]
        step = np.diff(flags, prepend=np.int8(0))
        self.start, self.stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.append(np.searchsorted(self.start, packed.start), len(self.start))
        self.count = np.diff(self.first)
        self.packed = packed

    def prefix_sums(self, lower: bool) -> np.ndarray:
        """Running sums of byte value times base power: the hash of any byte range is a difference."""
        up, _ = powers(len(self.packed.buf))
        sums = np.zeros(len(self.packed.buf) + 1, U64)
        np.cumsum(byte_values(lower)[self.packed.buf] * up[: len(self.packed.buf)], out=sums[1:])
        return sums

    def hashes(self, lower: bool, sums: np.ndarray | None = None, stop: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (or of the words ``at``; or of their bytes before ``stop``)."""
        sums = self.prefix_sums(lower) if sums is None else sums
        start = self.start if at is None else self.start[at]
        stop = (self.stop if at is None else self.stop[at]) if stop is None else stop
        _, down = powers(len(self.packed.buf))
        return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive word hashes, in place i for words i..i+length-1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(length):
        total += words[k : k + n] * U64((0xA0761D6478BD642F * (2 * k + 1) ** 3 + 2 * k) & (2**64 - 1) | 1)
    return mix(total + U64(length))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """True where a window of ``length`` words that begins at word i stays within its text."""
    n = int(first[-1])
    ok = np.zeros(max(0, n - length + 1), bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    ok[:] = (left >= length)[: len(ok)]
    return ok


def covered(first: np.ndarray, hits: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Mask of words inside any window that begins at ``hits``."""
    step = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + length, -1)
    return np.cumsum(step)[:-1] > 0


def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over the words of each text (0 for a text without words)."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]
