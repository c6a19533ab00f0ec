"""Classes of joined words against those of each word."""

import numpy as np

from tessera.llm import encoding


def test_classes_of_words_joined():
    """What a tokenizer may be given joined is told for all words at once."""
    words = ["abc", "a1", "x<|y", "<|", "<", "|", "Abc", "\u0130", "\u00e9\u017f", "\u0180", "\u00d7", "\U0001f600", "don't", "\u00a0"]
    plain, letters = encoding.Joined.plain(" ".join(words), np.array([len(w) for w in words]))
    assert plain.tolist() == [encoding._PLAIN(w) is not None and "<|" not in w for w in words]
    assert letters.tolist() == [p and w.isalpha() for p, w in zip(plain.tolist(), words)]
