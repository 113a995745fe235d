"""Associative scans of piecewise functions: a long run of state changes is cut, composed and replayed side by side.

A change of a whole-number state is a function made of pieces, each a shift (s + b) or a constant (b) from its lower bound
on. Such functions compose into such functions, and composition is associative: a run's changes are composed in a
binary tree, and walking the tree down again gives the state before every change. All runs of a batch go
through the tree together, in numpy; nothing here steps through rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States lie strictly between -LIMIT and LIMIT; inputs beyond are clamped by the callers.
LIMIT = 1 << 34
_SPAN = LIMIT * 4


@dataclass
class Pieces:
    """Functions 0..n-1: pieces sorted by (node, lo); every function has one that starts at -LIMIT."""

    node: np.ndarray
    lo: np.ndarray
    slope: np.ndarray  # 1: a shift by ``value``, 0: the constant ``value``
    value: np.ndarray

    def __post_init__(self) -> None:
        self.key = self.node * _SPAN + self.lo

    def _find(self, node: np.ndarray, state: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, node * _SPAN + state, side="right") - 1

    def at(self, node: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Function ``node`` applied to ``state``, elementwise."""
        i = self._find(node, state)
        return self.slope[i] * state + self.value[i]

    def take(self, chosen: np.ndarray) -> Pieces:
        """The functions that the boolean array names, renumbered in order."""
        number = np.cumsum(chosen) - 1
        own = chosen[self.node]
        return Pieces(number[self.node[own]], self.lo[own], self.slope[own], self.value[own])

    def moved(self, numbers: np.ndarray) -> Pieces:
        return Pieces(numbers[self.node], self.lo, self.slope, self.value)

    @staticmethod
    def merged(a: Pieces, b: Pieces) -> Pieces:
        node, lo, slope, value = (np.concatenate((getattr(a, x), getattr(b, x))) for x in ("node", "lo", "slope", "value"))
        order = np.argsort(node, kind="stable")
        return Pieces(node[order], lo[order], slope[order], value[order])

    def then(self, after: Pieces) -> Pieces:
        """Function k of ``after`` applied to the result of function k of this."""
        if len(self.node) == 0:
            return self
        last = np.append(self.node[1:] != self.node[:-1], True)
        high = np.where(last, LIMIT, np.append(self.lo[1:], 0)) - 1
        shift = self.slope == 1
        low = np.where(shift, np.maximum(self.lo + self.value, -LIMIT), self.value)
        high = np.where(shift, np.minimum(high + self.value, LIMIT - 1), self.value)
        first, end = after._find(self.node, low), after._find(self.node, np.maximum(high, low))
        size = end - first + 1
        own = np.repeat(np.arange(len(size)), size)
        of = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[own]
        moved = after.lo[of] - np.where(shift[own], self.value[own], 0)
        lo = np.where(shift[own], np.maximum(self.lo[own], moved), self.lo[own])
        slope = self.slope[own] * after.slope[of]
        value = after.slope[of] * self.value[own] + after.value[of]
        node = self.node[own]
        new = np.ones(len(node), bool)  # neighbours that say the same are one piece
        new[1:] = (node[1:] != node[:-1]) | (slope[1:] != slope[:-1]) | (value[1:] != value[:-1])
        return Pieces(node[new], lo[new], slope[new], value[new])


def compose_runs(changes: Pieces, run: np.ndarray) -> tuple[Pieces, list]:
    """(each run's composed function, the tree); ``run`` numbers every change's run from 0, ascending."""
    tree, now = [], changes
    while len(run) and (same := run[1:] == run[:-1]).any():
        n = len(run)
        start = np.concatenate(([True], ~same))
        place = np.arange(n) - np.flatnonzero(start)[np.cumsum(start) - 1]
        right = place % 2 == 1
        left = np.append(right[1:], False)
        parent = np.cumsum(~right) - 1
        tree.append((now, right, parent))
        alone = ~left & ~right
        both = now.take(left).then(now.take(right)).moved(parent[left])
        now = Pieces.merged(both, now.take(alone).moved(parent[alone]))
        run = run[~right]
    return now, tree


def states_before(tree: list, start: np.ndarray) -> np.ndarray:
    """The state before every change, from the state before each run."""
    state = start
    for functions, right, parent in reversed(tree):
        state = state[parent]
        at = np.flatnonzero(right)
        state[at] = functions.at(at - 1, state[at])
    return state
