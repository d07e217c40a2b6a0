"""Token ids of strings that come again and again, worked out once for as long as a worker keeps them."""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import chain, count, islice

import numpy as np


def _byte_letters() -> str:
    """A letter for each byte, as byte-level files write bytes: printable ones stand for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(letter[b] for b in range(256))


BYTE_LETTERS = _byte_letters()


class _Kept:
    """Strings by place, in the order in which they were first met, and their ids one after the other."""

    def __init__(self):
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, "int64"), np.zeros(0, "int64")

    def add(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if (more := len(self.place) - len(self.size)) > 0:
            self.start, self.size = np.concatenate([self.start, np.zeros(more, "int64")]), np.concatenate([self.size, np.zeros(more, "int64")])
        self.start[places], self.size[places] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids = np.concatenate([self.ids, ids])

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places in a row, and how many each has."""
        sizes = self.size[places]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[np.repeat(self.start[places], sizes) + inside], sizes


class Codes:
    """Ids by `learn`, which gives for distinct strings which of them, their ids in a row and how many each has, until all had a turn.

    Beyond `most` strings all become the old ones and a new collection begins; it takes from the old ones what is met
    again, and the ones before those are forgotten.  So a worker holds 2 * most strings and a block's at the most, and a
    string that keeps coming is never learnt twice.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], most: int):
        self.learn, self.most = learn, most
        self.old, self.kept = _Kept(), _Kept()
        gc.freeze()  # what a worker sets up once is never garbage

    def of(self, rows: list[list[str]]) -> tuple[np.ndarray, list[int]]:
        """The ids of all rows' strings in a row, and where each row's begin, with the end."""
        if len(self.kept.place) > self.most:
            self.old, self.kept = self.kept, _Kept()
        place = self.kept.place
        known = len(place)
        places = np.fromiter(map(place.__getitem__, chain.from_iterable(rows)), "int64", sum(map(len, rows)))
        new = list(islice(reversed(place), len(place) - known))[::-1]
        then = np.fromiter((self.old.place.get(key, -1) for key in new), "int64", len(new))
        met = np.flatnonzero(then >= 0)
        self.kept.add(known + met, *self.old.gather(then[met]))
        fresh = np.flatnonzero(then < 0)
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            for which, ids, sizes in self.learn([new[i] for i in some.tolist()]):
                self.kept.add(known + some[which], ids, sizes)
        ids, sizes = self.kept.gather(places)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, rows)])]
        return ids, ends.tolist()
