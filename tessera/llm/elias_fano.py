"""Elias-Fano sequences in memory-mapped arrays, with vectorised access and successor search."""

from __future__ import annotations

import os
import uuid

import numpy as np

U = np.uint64


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays under names of their own and renames them, so a task that is run twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    for key, x in arrays.items():
        own = f"{folder}/.{uuid.uuid4().hex}.npy"
        np.save(own, np.ascontiguousarray(x))
        os.replace(own, f"{folder}/{name}.{key}.npy")


def load(folder: str, name: str, *keys: str) -> list[np.ndarray]:
    return [np.load(f"{folder}/{name}.{k}.npy", mmap_mode="r") for k in keys]


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """values: ascending, not negative. Low bits packed end to end; high parts unary, each value's ones then
    a zero; a running count of ones for every 64 bits."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = min(56, max(0, ((top + 1) // n).bit_length() - 1)) if n else 0
    low = np.zeros(((n * width + 7) // 8 + 8), np.uint8)
    step = 1 << 15  # a multiple of eight values fills whole bytes
    for a in range(0, n if width else 0, step):
        part = values[a : a + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        raw = np.packbits(bits.ravel(), bitorder="little")
        low[a * width // 8 : a * width // 8 + len(raw)] = raw
    high = (values >> U(width)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    flags = np.zeros((size + 63) // 64 * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    words = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    return {"low": low, "high": words, "ones": ones, "head": np.array([n, width, size], np.int64)}


#: The place of the k-th one of a byte, at byte << 6 | k.
_PLACES = np.zeros(256 << 6, np.uint8)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _PLACES[_byte << 6 | _k] = _at


def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) one of each word: the byte by the ones up to each byte, which are summed all eight
    at once, then the place in it from a table."""
    k = k.astype(np.uint64)
    ones = word - ((word >> U(1)) & U(0x5555555555555555))
    ones = (ones & U(0x3333333333333333)) + ((ones >> U(2)) & U(0x3333333333333333))
    ones = ((ones + (ones >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
    full = (((k * U(0x0101010101010101)) | U(0x8080808080808080)) - ones) & U(0x8080808080808080)
    shift = np.bitwise_count(full).astype(np.uint64) << U(3)
    k -= ((ones << U(8)) >> shift) & U(0xFF)
    return (shift + _PLACES[((word >> shift) & U(0xFF)) << U(6) | k]).astype(np.int64)


class Sequence:
    def __init__(self, folder: str, name: str):
        self.low, self.high, self.ones, head = load(folder, name, "low", "high", "ones", "head")
        self.n, self.width, self.size = (int(x) for x in head)
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.mask = U((1 << self.width) - 1)
        self.bytes = np.ndarray(max(0, len(self.low) - 7), "<u8", self.low, strides=(1,))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint64)) & self.mask

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(counts, k, side="right") - 1
        word = self.high[w]
        return w * 64 + _in_word(~word if flip else word, k - counts[w])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.empty(0, np.uint64)
        high = self._select(self.ones, i, False) - i
        return (high.astype(np.uint64) << U(self.width)) | self._low(i)

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first value that is not below each key (n if there is none)."""
        keys = np.asarray(keys, np.uint64)
        if not self.n or not len(keys):
            return np.zeros(len(keys), np.int64)
        h = (keys >> U(self.width)).astype(np.int64)
        most = self.size - self.n - 1
        inside = np.minimum(h, most)
        end = self._select(self.zeros, inside, True) - inside
        before = np.maximum(inside - 1, 0)
        begin = np.where(inside > 0, self._select(self.zeros, before, True) - before, 0)
        low, want = begin.copy(), keys & self.mask
        span = int((end - begin).max(initial=0))
        hi = end.copy()
        while span:
            open_ = np.flatnonzero(low < hi)
            mid = (low[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            span >>= 1
        return np.where(h > most, self.n, low)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is missing."""
        i = self.successor(keys)
        ok = np.flatnonzero(i < self.n)
        out = np.full(len(i), -1, np.int64)
        ok = ok[self.at(i[ok]) == np.asarray(keys, np.uint64)[ok]]
        out[ok] = i[ok]
        return out
