"""Rows of numbers for words, computed once for each word that a worker meets."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Words a worker remembers before it starts anew; bounds memory, not results.
MOST_WORDS = 250_000

#: Longer words are split at what isn't a letter, and longer runs of letters into pieces of
#: PIECE, which the affix features cover whole.
LONG, PIECE = 32, 8

_runs = re.compile(r"([\W\d_]*)([^\W\d_]+)([\W\d_]*)").findall


def _pieces(word: str) -> list[str]:
    found = []
    for before, run, after in _runs(word):
        cuts = [run[i : i + PIECE] for i in range(0, len(run), PIECE)] if len(run) > LONG else [run]
        cuts[0], cuts[-1] = before + cuts[0], cuts[-1] + after if len(cuts) > 1 else before + run + after
        found += cuts
    return found or [word]


def words_of(text: str) -> list[str]:
    """What stands between Unicode white space, long words in pieces; no letter is left out."""
    words = text.split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in (_pieces(w) if len(w) > LONG else (w,))]


def letters(word: str) -> str:
    """The letters of a word in lower case, without what stands between or around them:
    digits, fractions and circled numbers are no letters."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def feature_slots(words: list[str], slots: int, prefixes=(), suffixes=(), grams=()) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of all features of the words, hashed side by side.

    The features are the word itself, prefixes and suffixes of the given lengths (only of
    words longer than that) and the n-grams of the word between marks. Empty words have none.
    `words_of` bounds their length. `slots` is a power of two.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    number = np.flatnonzero(size > 0)
    size = size[number]
    if not len(number):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.frombuffer("".join(f"<{w}>" for w in words if w).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(size + 2) - size - 1  # the first letter of each word
    factor = np.uint64(0x9E3779B97F4A7C15)
    found, owner = [], []

    def add(values: np.ndarray, kind: int, words: np.ndarray) -> None:
        values = (values ^ np.uint64(kind)) * factor
        values ^= values >> np.uint64(29)
        found.append(((values * factor) >> np.uint64(32)).astype(np.int64) & (slots - 1))
        owner.append(words)

    def run(at: np.ndarray, n: int) -> np.ndarray:
        values = np.zeros(len(at), np.uint64)
        for i in range(n):
            values = values * np.uint64(1_000_003) + text[at + i]
        return values

    whole = np.zeros(len(number), np.uint64)
    for i in range(int(size.max())):
        on = size > i
        whole[on] = whole[on] * np.uint64(1_000_003) + text[first[on] + i]
    add(whole, 1, number)
    for k in prefixes:
        on = size > k
        add(run(first[on], k), 100 + k, number[on])
    for k in suffixes:
        on = size > k
        add(run(first[on] + size[on] - k, k), 200 + k, number[on])
    word_at = np.repeat(np.arange(len(number)), size + 2)
    for k in grams:
        if len(text) >= k:
            at = np.flatnonzero(word_at[: len(text) - k + 1] == word_at[k - 1 :])
            add(run(at, k), 300 + k, number[word_at[at]])
    return np.concatenate(found), np.concatenate(owner)


def sums(weights: np.ndarray, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of `n` owners, the sum of its rows of `weights`."""
    return np.stack([np.bincount(owner, column[slot], n) for column in weights.T], 1)


class WordTable(dict):
    """Word -> row number; `values` has the rows, made in bulk by `make` when `flush`ed."""

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], most: int = MOST_WORDS):
        self.make, self.most = make, most
        self.values, self.new = np.empty((1024, width)), []
        self.count = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = self.count
        self.count += 1
        self.new.append(word)
        return at

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers and rows of all words of the texts in turn, and words per text."""
        if self.count > self.most:
            self.clear()
            self.count = 0
        found = [words_of(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter((i for words in found for i in map(self.__getitem__, words)), np.int64, int(counts.sum()))
        self.flush()
        return at, self.values[at], counts

    def flush(self) -> None:
        if self.new:
            while self.count > len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            self.values[self.count - len(self.new) : self.count] = self.make(self.new)
            self.new = []

