"""Token ids of whole texts under a public tokenizer, encoded once per distinct word.

The vocabulary's pre-tokenizer never joins characters across white space and drops it, so a text's ids
are the ids of its white-space-separated words, one after the other. Words repeat; each worker encodes a
distinct word once and looks up the rest. `exact_by_words` tells whether a tokenizer has that property;
for others whole texts are encoded.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import regex

#: Distinct words that a worker remembers.
CACHE_WORDS = 300_000
#: Text bytes to encode at once.
TEXT_BYTES = 2 << 20
#: Lower-case letters, digits and signs of ASCII, and Latin letters but the dotted capital I.
_PLAIN = regex.compile(r"[!-@\[-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: By code point, all from 0x180 on as one: what _PLAIN takes, and letters. A space parts words and is both.
_PLAINS = np.array([c == 32 or _PLAIN(chr(c)) is not None for c in range(0x180)] + [False])
_LETTERS = np.array([c == 32 or chr(c).isalpha() for c in range(0x180)] + [False])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def exact_by_words(path: str) -> bool:
    """Whether texts may be cut at ASCII white space before encoding: white space is dropped there."""
    t = _tokenizer(path)
    return all(t.encode(f"ab{x}cd", add_special_tokens=False).ids == t.encode("ab", add_special_tokens=False).ids + t.encode("cd", add_special_tokens=False).ids for x in (" ", "\n", " \t\r\n", "  ")) and not t.encode(" \n ", add_special_tokens=False).ids


class Numbers(dict):
    """Words by number. A word that is asked for and not known gets the next number and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Joined:
    """Encodes many words as one text and cuts the ids where words end.

    This needs a BPE whose pre-tokens end in a token of their own kind (an end-of-word suffix): a word then has
    as many such tokens as the tokenizer's own split pattern finds pre-tokens in it. Only words of lower-case
    letters and signs whose classes and normal form are beyond doubt are joined; `plain` tells which."""

    #: Words a text: more slow the tokenizer down.
    WORDS = 500

    def __init__(self, tokenizer):
        told = json.loads(tokenizer.to_str())
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        suffix = told["model"].get("end_of_word_suffix")
        self.usable = bool(suffix) and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "Regex" in split.get("pattern", {})
        if self.usable:
            self.tokenizer = tokenizer
            self.pieces = regex.compile(split["pattern"]["Regex"]).findall
            ids = tokenizer.get_vocab()
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
            self.letters_are_one = len(self.pieces("abcxyz\xe0\xff\u0101\u017f")) == 1

    @staticmethod
    def plain(joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words of these lengths, joined by spaces, are plain, and which of those are letters only."""
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0x180)
        starts = np.cumsum(lengths + 1) - lengths - 1
        plain = np.logical_and.reduceat(_PLAINS[codes], starts)
        special = np.flatnonzero((codes[:-1] == ord("<")) & (codes[1:] == ord("|")))
        plain[np.searchsorted(starts, special, "right") - 1] = False
        return plain, plain & np.logical_and.reduceat(_LETTERS[codes], starts)

    def encode(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids and the number of ids of each word; None if the ends don't tally. letters: words of letters only."""
        counts = np.ones(len(words), np.int64)
        other = np.flatnonzero(~letters) if self.letters_are_one else np.arange(len(words))
        counts[other] = [len(self.pieces(words[i])) for i in other.tolist()]
        groups = [" ".join(words[a : a + self.WORDS]) for a in range(0, len(words), self.WORDS)]
        each = [np.array(x.ids, np.uint32) for x in _batch_of(self.tokenizer, groups)]
        ends = [np.flatnonzero(self.ends[x]) + 1 for x in each]
        if [len(x) for x in ends] != [int(counts[a : a + self.WORDS].sum()) for a in range(0, len(words), self.WORDS)] or not counts.all():
            return None
        before = np.cumsum([0] + [len(x) for x in each])[:-1]
        last = np.concatenate([e + b for e, b in zip(ends, before)])[np.cumsum(counts) - 1]
        return np.concatenate(each), np.diff(last, prepend=0)


def _batch_of(tokenizer, texts: list[str]) -> list:
    return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)(texts, add_special_tokens=False)


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer, self.limit, self.by_words = _tokenizer(path), cache_words, exact_by_words(path)
        self.lower = self._batch(["AbC"]) == self._batch(["abc"])
        self.joined = Joined(self.tokenizer)
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.flat, self.n = np.empty(1 << 16, np.uint32), 0
        self.offsets, self.lengths, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the words used twice or more, at most half of the limit: most words are rare."""
        uses = self.uses[: len(self.known)]
        keep = np.flatnonzero(uses >= 2)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: self.limit // 2]])
        chosen = np.zeros(len(uses), bool)
        chosen[keep] = True
        words, uses, lengths = list(compress(self.known, chosen.tolist())), uses[keep] // 2, self.lengths[keep]
        flat = self._ids(keep)
        self._clear()
        self.known.update(zip(words, range(len(words))))
        self._reserve()
        self._store(np.arange(len(words)), flat, lengths)
        self.uses[: len(words)] = uses

    def _reserve(self) -> None:
        if len(self.known) > len(self.offsets):
            self.offsets, self.lengths, self.uses = (np.concatenate((x, np.zeros(2 * len(self.known) - len(x), np.int64))) for x in (self.offsets, self.lengths, self.uses))

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the words with these numbers, end to end."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.offsets[numbers] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in _batch_of(self.tokenizer, texts)]

    def _store(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.n + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.n + len(flat)))
        self.flat[self.n : self.n + len(flat)] = flat
        self.offsets[numbers] = self.n + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.n += len(flat)

    def _learn(self, new: list[bytes]) -> None:
        """Encodes the words that were numbered last."""
        first, joined = len(self.known) - len(new), b" ".join(new).decode("utf-8", "replace")
        texts = joined.split(" ")
        self._reserve()
        plain = letters = np.zeros(len(texts), bool)
        if self.joined.usable:
            plain, letters = self.joined.plain(joined, np.fromiter(map(len, texts), np.int64, len(texts)))
        for a in range(0, len(texts), 1 << 15):
            own = np.flatnonzero(plain[a : a + (1 << 15)]) + a
            if len(own) and (got := self.joined.encode([texts[i] for i in own.tolist()], letters[own])):
                self._store(first + own, *got)
            else:
                plain[own] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            ids = self._batch([texts[i] for i in rest.tolist()])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(first + rest, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def _numbers(self, words: list[list[bytes]], n: int) -> np.ndarray:
        if len(self.known) > self.limit:
            self._forget()
        try:
            index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, n)
            if self.known.new:
                self._learn(self.known.new)
                self.known.new = []
            self.uses[: len(self.known)] += np.bincount(index, minlength=len(self.known))
        except BaseException:  # words may be numbered but not encoded
            self._clear()
            raise
        return index

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each; `end` is appended to each."""
        if not self.by_words:
            ids = [x + ([] if end is None else [end]) for x in self._batch([t.decode("utf-8", "replace") for t in texts])]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths
        # the tokenizer lower-cases all but its special tokens, which <| begins
        words = [(t if b"<|" in t or not self.lower else t.lower()).split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        index = self._numbers(words, int(counts.sum()))
        flat = self._ids(index)
        upto = np.concatenate(([0], np.cumsum(self.lengths[index])))[np.concatenate(([0], np.cumsum(counts)))]
        per_text = np.diff(upto)
        if end is not None:
            flat = np.insert(flat, upto[1:], end).astype(np.uint32)
            per_text = per_text + 1
        return flat, per_text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder: what it has learnt serves its later tasks too."""
    return Encoder(path)
