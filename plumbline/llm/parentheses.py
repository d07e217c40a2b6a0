"""A trie's shape as balanced parentheses, with the excess of fixed blocks for closing any of them."""

from __future__ import annotations

import numpy as np

BLOCK = 256
_AT_ONCE = 4096


class Parentheses:
    """A part of a sequence of parentheses (True opens), whose first nodes may hang on ones that are open already.

    The excess is the number of open ones less that of closed ones so far.  Blocks keep their least and most excess, and a
    tree over the blocks the least and most of each half, quarter and so on, so that finding where an open one closes looks
    into two blocks and climbs the tree in between.
    """

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype("i8")
        self.blocks = max(1, -(-len(bits) // BLOCK))
        self.leaves = 1 << (self.blocks - 1).bit_length()
        high = np.iinfo("i8").max
        padded = np.full(self.blocks * BLOCK, high)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(self.blocks, BLOCK)
        self.least = np.full(2 * self.leaves, high)  # a heap: node i has halves 2 i and 2 i + 1
        self.least[self.leaves : self.leaves + self.blocks] = self.rows.min(1)
        self.most = np.full(2 * self.leaves, np.iinfo("i8").min)
        self.most[self.leaves : self.leaves + self.blocks] = np.where(self.rows == high, np.iinfo("i8").min, self.rows).max(1)
        for i in range(self.leaves - 1, 0, -1):
            self.least[i], self.most[i] = min(self.least[2 * i], self.least[2 * i + 1]), max(self.most[2 * i], self.most[2 * i + 1])
        pair = np.zeros(len(bits), bool)
        pair[:-1] = bits[:-1] & ~bits[1:]
        self._opened, self._pairs = np.cumsum(bits), np.cumsum(pair)

    def rank(self, position: np.ndarray) -> np.ndarray:
        """How many open up to a position, itself included."""
        return self._opened[position]

    def leaf_rank(self, position: np.ndarray) -> np.ndarray:
        """How many leaves, that is pairs of one that opens and closes at once, begin up to a position."""
        return self._pairs[position]

    def _first_in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of each block, beyond `after`, whose excess is the target; -1 if none is."""
        out = np.full(len(block), -1)
        for at in range(0, len(block), _AT_ONCE):
            some = slice(at, at + _AT_ONCE)
            hit = (self.rows[block[some]] == target[some, None]) & (np.arange(BLOCK) > after[some, None])
            first = hit.argmax(1)
            out[some] = np.where(hit[np.arange(len(first)), first], first, -1)
        return out

    def find_close(self, opened: np.ndarray) -> np.ndarray:
        """Where those that open at the positions close; -1 if they don't within this part."""
        target = self.excess[opened] - 1
        block = opened // BLOCK
        inside = self._first_in_block(block, opened % BLOCK, target)
        out = np.where(inside >= 0, block * BLOCK + inside, -1)
        open_ = np.flatnonzero(inside < 0)
        node, goal = self.leaves + block[open_], target[open_]
        going = np.ones(len(open_), bool)  # up, until the half to the right goes as low as the goal
        while going.any():
            right = np.minimum(node + 1, 2 * self.leaves - 1)
            found = going & (node % 2 == 0) & (self.least[right] <= goal)
            node = np.where(found, right, np.where(going, node // 2, node))
            going &= ~found & (node > 1)
        down = node > 1
        while (down & (node < self.leaves)).any():  # down, to the first block that does
            step = down & (node < self.leaves)
            left = 2 * np.where(step, node, 0)
            node = np.where(step, np.where(self.least[left] <= goal, left, left + 1), node)
        open_, goal, block = open_[down], goal[down], node[down] - self.leaves
        out[open_] = block * BLOCK + self._first_in_block(block, np.full(len(block), -1), goal)
        return out


def of_depths(depths: np.ndarray, last_is_leaf: bool) -> tuple[Parentheses, np.ndarray]:
    """(parentheses, where each node opens) of nodes in preorder.  The last node closes only if it is a leaf, and what it
    hangs on stays open."""
    closing = np.concatenate([np.zeros(1, "i8"), depths[:-1] - depths[1:] + 1])
    opens = np.arange(len(depths)) + np.cumsum(closing)
    bits = np.zeros(int(opens[-1]) + 1 + last_is_leaf, bool)
    bits[opens] = True
    return Parentheses(bits), opens
