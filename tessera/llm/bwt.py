"""Burrows-Wheeler transforms of small string collections, and their merge by interleave refinement.

Strings end in a terminator that is smaller than every byte; equal suffixes are ordered by string number.
A merge starts from the transforms laid one after the other and repeats one stable pass by preceding
character. After h passes the interleaving is right for the first h characters, and a place where a block
first splits in pass h is a common prefix of h - 1 characters. No suffix is sorted again.
"""

from __future__ import annotations

import numpy as np


class Strings:
    """Strings end to end, each followed by a terminator (0; bytes are stored plus one)."""

    def __init__(self, items: list[bytes]):
        self.lengths = np.fromiter(map(len, items), np.int64, len(items))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.text = np.zeros(int(self.lengths.sum()) + len(items), np.uint16)
        body = np.frombuffer(b"".join(items), np.uint8).astype(np.uint16) + 1
        at = np.arange(len(body)) + np.repeat(np.arange(len(items)), self.lengths)
        self.text[at] = body


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank, key = np.zeros(len(key), np.int64), key[order]
    rank[order[1:]] = np.cumsum(key[1:] != key[:-1])
    return rank


def transform(s: Strings, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order by at least `depth` characters (positions in s.text) and the preceding characters, by
    prefix doubling. The character before a string's start is its terminator."""
    n = len(s.text)
    ends = np.repeat(s.starts + s.lengths, s.lengths + 1)
    room = ends - np.arange(n)  # characters up to the terminator
    top = min(depth, int(s.lengths.max(initial=0)) + 1)
    # seven characters of nine bits; what lies behind the terminator counts as zero
    key = np.zeros(n, np.int64)
    for i in range(7):
        key <<= 9
        if i < n:
            key[: n - i] |= np.where(room[: n - i] > i, s.text[i:], 0)
    order = np.argsort(key, kind="stable")
    rank, width = _ranks(key, order), 7
    while width < top and not (n and rank[order[-1]] == n - 1):
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(room >= width)
        ahead[inside] = rank[inside + width] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = _ranks(key, order)
        width *= 2
    before = np.where(np.isin(order, s.starts), np.uint16(0), s.text[order - 1])
    return order, before


def merge(before: list[np.ndarray], step: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms. step: for each place of the concatenated transforms that of the suffix that is one
    character longer. depth: below 256. Returns places (for each place of the merged order the index into the concatenated
    transforms) right for `depth` characters, and the length of the common prefix with the place before, at
    most `depth`."""
    chars = np.concatenate(before)
    n, bases = len(chars), np.cumsum([0] + [len(b) for b in before])
    chars = chars.astype(np.uint8 if int(chars.max(initial=0)) < 256 else np.uint16)
    ends = int((chars == 0).sum())
    # suffixes that are only a terminator come first, in the order of the transforms
    first = np.concatenate([base + np.arange(int((b == 0).sum()), dtype=np.int32) for b, base in zip(before, bases)]) if n else np.empty(0, np.int32)
    place, block, common = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.zeros(n, np.uint8)
    new = np.ones(n, bool)  # terminators differ from one another and from all else
    for _ in range(depth):
        there = chars[place]
        by = np.argsort(there, kind="stable")[ends:]
        came, c = block[by], there[by]
        place = np.concatenate((first, step[place[by]]))
        if n > ends:
            np.not_equal(c[1:], c[:-1], out=new[ends + 1 :])
            new[ends + 1 :] |= came[1:] != came[:-1]
        common += ~new  # a block's head stays one
        block = np.cumsum(new, dtype=np.int32)
        if block[-1:] == n:
            break
    return place, common


def repeated(items: list[bytes], docs: np.ndarray, width: int, shards: int = 4) -> list[np.ndarray]:
    """For each string the smallest of docs over all strings that hold the same `width` bytes, for every
    start of such a window in it."""
    parts, orders, before, base = np.array_split(np.arange(len(items)), min(shards, max(1, len(items)))), [], [], 0
    starts, owner = [], []
    for part in parts:
        s = Strings([items[i] for i in part])
        order, b = transform(s, width)
        orders.append(order + base)
        before.append(b)
        starts.append(s.starts + base)
        owner.append(np.repeat(part, s.lengths + 1))
        base += len(s.text)
    order, owner, first = np.concatenate(orders), np.concatenate(owner), np.concatenate(starts)
    rank = np.empty(base, np.int32)
    rank[order] = np.arange(base, dtype=np.int32)
    place, common = merge(before, rank[order - 1], width)
    at = order[place]
    heads = np.flatnonzero(common < width)
    least = np.minimum.reduceat(docs[owner[at]], heads) if len(heads) else np.empty(0, np.int64)
    of = np.empty(base, np.int64)
    of[at] = np.repeat(least, np.diff(np.append(heads, len(at))))
    return [of[a : a + max(0, len(x) - width + 1)] for a, x in zip(first.tolist(), items)]
