"""A select in a word against brute force."""

import numpy as np

from tessera.llm import elias_fano


def test_places_of_ones():
    """A select in a word takes a table, not six halvings: some 20 operations an array."""
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 2**64, 3000, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64), np.full(64, 2**64 - 1, np.uint64)])
    k = rng.integers(0, 1 << 30, len(words)) % np.bitwise_count(words)
    k[-64:] = np.arange(64)
    want = [[i for i in range(64) if w >> i & 1][j] for w, j in zip(words.tolist(), k.tolist())]
    assert elias_fano._in_word(words, k).tolist() == want and len(elias_fano._PLACES) == 256 << 6
