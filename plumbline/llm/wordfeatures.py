"""Hashed features of words, for the two models that score words: affixes, n-grams and the word itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Runs of letters; marks that combine with a letter belong to it.
WORD = regex.compile(r"[\p{L}\p{M}]+")
HAS_LETTER = regex.compile(r"\p{L}")
#: Distinct words that a worker keeps scored; beyond that it forgets all and starts again.
KEPT_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: list[str], bits: int, prefixes: Iterable[int], suffixes: Iterable[int], grams: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs, sorted by word: hashed numbers below 2**bits and positions in `words`.

    The features of a word: itself, its prefixes, suffixes and inner n-grams of the lengths given (shorter words have fewer).
    """
    size = np.fromiter(map(len, words), "int64", len(words))
    if not size.sum():
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64") + np.uint64(1)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(points)) - start[owner]
    power = np.ones(int(size.max()), "uint64")
    np.multiply.accumulate(np.full(len(power) - 1, _ODD), out=power[1:]) if len(power) > 1 else None
    found, whose = [], []

    def add(kind: int, hashed: np.ndarray, of: np.ndarray) -> None:
        mixed = (hashed ^ np.uint64((kind * 0xD6E8FEB86659FD93) & (2**64 - 1))) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        found.append((mixed >> np.uint64(64 - bits)).astype("int64"))
        whose.append(of)

    def run(at: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(at), "uint64")
        for k in range(length):
            out = out * _ODD + points[at + k]
        return out

    filled = np.flatnonzero(size)
    add(1, np.add.reduceat(points * power[inside], start[filled]), filled)
    for n in prefixes:
        of = np.flatnonzero(size >= n)
        add(100 + n, run(start[of], n), of)
    for n in suffixes:
        of = np.flatnonzero(size >= n)
        add(200 + n, run(start[of] + size[of] - n, n), of)
    for n in grams:
        at = np.flatnonzero(inside + n <= size[owner])
        add(300 + n, run(at, n), owner[at])
    feature, word = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(word, kind="stable")
    return feature[order], word[order]


class WordScores:
    """Rows of scores for words, worked out once for each distinct word that a worker meets."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int):
        self.score, self.width = score, width
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        if len(self.place) > KEPT_WORDS:
            self.forget()
        new = list(set(words).difference(self.place))
        if new:
            first = len(self.place)
            if first + len(new) > len(self.rows):
                grown = np.zeros((2 * (first + len(new)), self.width))
                grown[:first] = self.rows[:first]
                self.rows = grown
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                self.rows[first + at : first + at + len(part)] = self.score(part)
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.place.__getitem__, words), "int64", len(words))]


def blocks(texts: pa.Array, most: int) -> Iterator[list[list[str]]]:
    """The texts' words, whole texts together, in blocks of about `most` words; a longer text is a block of its own."""
    held, size = [], 0
    for text in texts:
        words = words_of(text.as_py())
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held
