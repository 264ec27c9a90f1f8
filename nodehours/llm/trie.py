"""Double-array tries of number sequences, matched at all positions of a text at once."""

from __future__ import annotations

import numpy as np

TRIES = 64  # places tried together for the children of a node
ROUNDS = 16  # of such tries before the arrays grow instead


class DoubleArray:
    """A trie in two arrays: a state s moves on symbol c to base[s] + c if check there is s.

    sequences is a matrix of non-negative symbols, short rows filled with -1; labels numbers its distinct rows. Every
    prefix of a row is a state, which only labelled ones report. Symbols are renumbered from 0 in their order.
    """

    def __init__(self, sequences: np.ndarray, labels: np.ndarray) -> None:
        order = np.lexsort(sequences.T[::-1])
        sequences, labels = sequences[order], labels[order]
        self.depth = sequences.shape[1]
        self.symbols = np.unique(sequences[sequences >= 0])
        used = sequences >= 0
        codes = np.where(used, np.searchsorted(self.symbols, sequences), -1).astype(np.int64)
        width = len(self.symbols)
        size = 1 + width + 2 * len(sequences) * self.depth
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.label = np.full(size, -1, np.int64)
        self.free = np.ones(size, bool)
        self.free[0] = False  # the root
        self._rng = np.random.default_rng(0)
        at = np.zeros(len(codes), np.int64)  # state that each row has reached
        rows = np.arange(len(codes))
        for d in range(self.depth):
            rows = rows[codes[rows, d] >= 0]
            if not len(rows):
                break
            # rows are sorted, so a node's rows and each child's rows are neighbours
            parent, code = at[rows], codes[rows, d]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])])
            slot = self._placed(parent[new], code[new], width)
            at[rows] = slot[np.cumsum(new) - 1]
            ends = rows[(codes[rows, d + 1] < 0)] if d + 1 < self.depth else rows
            self.label[at[ends]] = labels[ends]
        top = int(np.flatnonzero(~self.free)[-1]) + 1 + width  # a step from any state stays inside
        self.base, self.check, self.label = self.base[:top].astype(np.int32), self.check[:top].astype(np.int32), self.label[:top].copy()
        del self.free

    def _placed(self, parent: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
        """Slots for the children of some nodes, given node by node; the largest nodes are placed first."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        count = np.diff(np.append(first, len(parent)))
        slot = np.empty(len(parent), np.int64)
        several = first[count > 1][np.argsort(-count[count > 1], kind="stable")]
        size_of = dict(zip(first.tolist(), count.tolist(), strict=True))
        for lo in several.tolist():
            mine = code[lo:lo + size_of[lo]]
            b = self._gap(mine, width)
            slot[lo:lo + len(mine)] = b + mine
            self.free[b + mine] = False
        lone = first[count == 1]
        if len(lone):
            room = np.flatnonzero(self.free)
            room = room[room >= width][:len(lone)]  # so that no base is negative
            if len(room) < len(lone):
                low = len(self.free)
                self._grow(len(lone) - len(room) + width)
                room = np.append(room, np.arange(max(low, width), max(low, width) + len(lone) - len(room)))
            slot[lone] = room
            self.free[room] = False
        self.base[parent] = slot - code
        self.check[slot] = parent
        return slot

    def _gap(self, codes: np.ndarray, width: int) -> int:
        """A base at which all the slots of these symbols are free."""
        for _ in range(ROUNDS):
            some = self._rng.integers(0, len(self.free) - width, TRIES)
            fits = self.free[some[:, None] + codes[None, :]].all(1)
            if fits.any():
                return int(some[np.argmax(fits)])
        low = len(self.free)
        self._grow(2 * width + 1)
        return low

    def _grow(self, n: int) -> None:
        self.base = np.append(self.base, np.zeros(n, np.int64))
        self.check = np.append(self.check, np.full(n, -1, np.int64))
        self.label = np.append(self.label, np.full(n, -1, np.int64))
        self.free = np.append(self.free, np.ones(n, bool))

    def codes_of(self, symbols: np.ndarray) -> np.ndarray:
        """The trie's own numbers of symbols, -1 for those that no sequence holds."""
        at = np.minimum(np.searchsorted(self.symbols, symbols), max(len(self.symbols) - 1, 0))
        return np.where(self.symbols[at] == symbols, at, -1).astype(np.int32) if len(self.symbols) else np.full(len(symbols), -1, np.int32)

    def visit(self, text: np.ndarray, most: int, total: np.ndarray) -> None:
        """Add to total how often each state is reached from the first most positions of a text of the trie's own numbers (-1: none)."""
        self.walk(text, np.flatnonzero(text[:most] >= 0), total)

    def walk(self, text: np.ndarray, at: np.ndarray, total: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Add to total how often each state is reached from some positions of a text, each counted by its weight (None: 1).

        All positions move together, one level after the other; those without a transition fall out.
        """
        text = np.append(text, np.full(self.depth, -1, text.dtype))
        state = np.zeros(len(at), np.int32)
        for _ in range(self.depth):
            to = self.base[state] + text[at]
            stays = np.flatnonzero((text[at] >= 0) & (self.check[to] == state))
            at, state = at[stays] + 1, to[stays]
            if weight is not None:
                weight = weight[stays]
            total += np.bincount(state, weight, minlength=len(total)).astype(np.int64)
