"""Runs of numbers (token ids, links) by word, for tokenizers whose result for a text is that of its words in a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Runs:
    """Runs of 64-bit numbers, kept one after the other; a run is fetched by its index."""

    def __init__(self) -> None:
        self.flat, self.begin, self.n, self.used = np.empty(1 << 16, np.int64), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("flat", self.used + len(flat)), ("begin", self.n + len(sizes) + 1)):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), np.int64)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def sizes(self, index: np.ndarray) -> np.ndarray:
        return self.begin[index + 1] - self.begin[index]

    def take(self, index: np.ndarray) -> np.ndarray:
        """The runs of ``index``, one after the other."""
        n = self.sizes(index)
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[index] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Numbers words as they come; ``learn(words)`` is told of new ones, in that order. ``forget()`` is called when the words
    known pass a bound, so that memory stays bounded whatever the text."""

    def __init__(self, learn: Callable[[list], None], forget: Callable[[], None], most: int = 200_000, most_chars: int = 8_000_000) -> None:
        self.known: dict = {}
        self.chars, self.learn, self.forget, self.most, self.most_chars = 0, learn, forget, most, most_chars

    def numbers(self, words: list) -> np.ndarray:
        if len(self.known) > self.most or self.chars > self.most_chars:
            self.known, self.chars = {}, 0
            self.forget()
        known, new = self.known, []
        out = list(map(known.get, words))
        if None in out:
            for i, at in enumerate(out):
                if at is None:
                    w = words[i]
                    at = known.get(w)
                    if at is None:
                        at = known[w] = len(known)
                        new.append(w)
                        self.chars += len(w)
                    out[i] = at
            self.learn(new)
        return np.array(out, np.int64)
