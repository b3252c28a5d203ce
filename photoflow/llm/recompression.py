"""Recompression: a sequence as a run-length grammar, and longest common extensions read from it.

Levels alternate between block compression (each maximal block of one symbol becomes one symbol) and pair compression
(symbols are dealt to two sides, and each left-right pair becomes one symbol). Equal stretches get equal symbols but for
their ends, so two places agree as far as their symbols do, level by level. No suffix array or hash of a stretch is used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: A symbol that ends a sequence: never compressed, and equal to nothing.
STOP = -1


class Grammar:
    """The grammar of ``symbols`` (int64, 0 and more), which may hold many sequences with ``STOP`` before, between and after them.

    A level has ``sym``, its symbols; ``up``, for each the number of its group, the next level's symbol; ``first``, where
    groups start; and whether its groups are blocks.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        sym, seed = np.asarray(symbols, dtype=np.int64), 0
        while ((sym[1:] != STOP) & (sym[:-1] != STOP)).any():
            for blocks in (True, False):
                starts = np.ones(len(sym), dtype=bool)
                starts[1:] = (sym[1:] != sym[:-1]) | (sym[1:] == STOP) if blocks else ~self._pairs(sym, seed)
                if starts.all():
                    continue
                first = np.append(np.flatnonzero(starts), len(sym)).astype(np.int32)
                head, size = sym[first[:-1]], np.diff(first)
                rest = size.astype(np.int64) if blocks else np.where(size == 2, sym[first[1:] - 1], STOP) + 1
                named = pd.factorize(head * (int(rest.max()) + 1) + rest)[0]
                named[head == STOP] = STOP
                self.levels.append((sym, (np.cumsum(starts) - 1).astype(np.int32), first, blocks))
                sym = named
            seed += 1

    @staticmethod
    def _pairs(sym: np.ndarray, seed: int) -> np.ndarray:
        """By symbol but the first, whether it is the right one of a pair; of both directions the one with more pairs."""
        side = np.append(np.random.default_rng(seed).integers(0, 2, int(sym.max()) + 1, dtype=np.int8), np.int8(2))[sym]  # STOP is the last
        a, b = side[:-1], side[1:]
        one, other = (a == 0) & (b == 1), (a == 1) & (b == 0)
        return one if np.count_nonzero(one) >= np.count_nonzero(other) else other

    def extend(self, a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols from places ``a`` and ``b`` on agree, all queries at once; with ``step`` -1 how many before them.

        Upwards: while both places' symbols agree, what reaches to a boundary of the next level is passed over and the
        places go up. Downwards from where they differ: each level adds at most one pair's left symbol or part of a block.
        """
        x, y, height = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), dtype=np.int16)
        at = 0 if step > 0 else -1
        live = np.arange(len(a))
        for h, (sym, up, first, blocks) in enumerate(self.levels):
            i, j = x[live], y[live]
            s = sym[i + at]
            same = (s == sym[j + at]) & (s != STOP)
            live, i, j = live[same], i[same], j[same]
            if not len(live):
                break
            move = np.flatnonzero((first[up[i]] != i) | (first[up[j]] != j))
            n = self._reach(i[move], j[move], up, first, blocks, step)
            i[move] += step * n
            j[move] += step * n
            go = (first[up[i]] == i) & (first[up[j]] == j)
            x[live], y[live] = np.where(go, up[i], i), np.where(go, up[j], j)
            live = live[go]
            height[live] = h + 1
        for h in range(int(height.max(initial=0)), -1, -1):
            if h == len(self.levels):  # at the top a sequence is one symbol, which two places of it can't both start
                continue
            sym, up, first, blocks = self.levels[h]
            own = np.flatnonzero(height > h)
            i, j = first[x[own]].astype(np.int64), first[y[own]].astype(np.int64)
            s = sym[i + at]
            same = np.flatnonzero((s == sym[j + at]) & (s != STOP))
            n = self._reach(i[same], j[same], up, first, blocks, step)
            i[same] += step * n
            j[same] += step * n
            x[own], y[own] = i, j
        return step * (x - a)

    @staticmethod
    def _reach(i, j, up, first, blocks: bool, step: int):
        """How far equal symbols at ``i`` and ``j`` go within their groups: a pair's other symbol is looked at anew."""
        if not blocks:
            return 1
        if step > 0:
            return np.minimum(first[up[i] + 1] - i, first[up[j] + 1] - j)
        return np.minimum(i - first[up[i - 1]], j - first[up[j - 1]])
