"""Word and word-sequence hashes of whole batches of texts, by array operations.

A word's hash sums random 64-bit values of its bytes times powers of an odd number; sequences are hashed from prefix
sums over mixed word hashes, so the hash of any run of words costs the same. All arithmetic is modulo 2 ** 64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(77003)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_WORD = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of two independent sequence hashes, and their inverses modulo 2 ** 64.
_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n."""
    if base not in _powers or len(_powers[base]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base & ((1 << 64) - 1), np.uint64))])
    return _powers[base][: n + 1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finalizer."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch: where each begins and ends in `raw`, its text and its hash. Texts are UTF-8 bytes; null is empty."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        raw = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        solid = np.empty(len(raw) + 1, bool)
        solid[0] = False
        solid[1:] = (raw != 32) & ((raw < 9) | (raw > 13))
        change = np.flatnonzero(solid[1:] != solid[:-1])
        self.raw, self.begin, self.end = raw, change[::2], change[1::2]
        text_end = np.cumsum(sizes + 1)
        self.starts = text_end - sizes - 1  # of each text, where it begins
        self.first = np.searchsorted(self.begin, self.starts)  # of each text, its first word
        self.count = np.diff(np.append(self.first, len(self.begin)))
        self.of = np.repeat(np.arange(len(texts)), self.count)
        length = self.end - self.begin
        if len(length):
            where = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            flat = np.repeat(self.begin, length) + where
            self.hash = mix(np.add.reduceat(_BYTE[raw[flat]] * powers(int(_WORD), int(length.max()))[where], np.cumsum(length) - length) + length.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self._sums = []
        for k, base in enumerate(_BASES):
            value = mix(self.hash, k + 1) * powers(base, len(self.hash))[: len(self.hash)]
            self._sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)]))

    def run(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the words start ... stop - 1; equal sequences have equal hashes wherever they stand."""
        back = powers(_INVERSES[which], len(self.hash))[start]
        return mix((self._sums[which][stop] - self._sums[which][start]) * back + (stop - start).astype(np.uint64), 7 + which)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
