"""A compressed quadtree over a grid of terms (rows) and documents (columns) whose cells know their greatest value.

A cell that holds one point is a leaf with that point; any other has up to four children. Cells are numbered level by
level, children of a cell beside each other, so that four bits a cell give the whole shape; values are kept as what they
lack to the parent's. A query of several rows descends their paths together over ranges of columns: the sum of the
weighted maxima of its cells bounds every column's score in a range, and the ranges of greatest bounds are split first.
"""

from __future__ import annotations

import numpy as np
import zstandard

#: Ranges of columns that are split at once.
WIDTH = 256
_ONES = np.array([bin(k).count("1") for k in range(16)], dtype=np.int32)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**31 with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _packed(x: np.ndarray) -> bytes:
    """By bytes of one weight, which are more alike than whole numbers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def pack(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> dict:
    """The tree of points (each place once, values above 0) as ``side`` (bits), ``levels`` (cells of each), ``kids, lacks, rows, cols``."""
    side = max(int(rows.max(initial=0)), int(cols.max(initial=0))).bit_length()
    code = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(code, kind="stable")
    code, rows, cols, values = code[order], rows[order], cols[order], values[order]
    kids, tops, lacks, leaf_rows, leaf_cols, levels = [], None, [], [], [], []
    for level in range(side + 1):
        if not len(code):
            break
        key = code >> np.uint64(2 * (side - level))
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
        count, top = np.diff(np.append(starts, len(key))), np.maximum.reduceat(values, starts)
        if level:
            parent = key[starts] >> np.uint64(2)
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), parent[1:] != parent[:-1])))
            own = kids[-1]
            own[own == 255] = np.bitwise_or.reduceat(np.left_shift(1, (key[starts] & np.uint64(3)).astype(np.int64)), first).astype(np.uint8)
            lacks.append(np.repeat(tops, np.diff(np.append(first, len(starts)))) - top)
        else:
            lacks.append(top)
        leaf = count == 1
        kids.append(np.where(leaf, 0, 255).astype(np.uint8))
        levels.append(len(starts))
        tops = top[~leaf]
        leaf_rows.append(rows[starts[leaf]])
        leaf_cols.append(cols[starts[leaf]])
        inner = np.repeat(~leaf, count)
        code, rows, cols, values = code[inner], rows[inner], cols[inner], values[inner]
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return {"side": side, "levels": levels, "kids": zstandard.ZstdCompressor(level=1).compress(joined(kids).astype(np.uint8).tobytes()), "lacks": _packed(joined(lacks)), "rows": _packed(joined(leaf_rows)), "cols": _packed(joined(leaf_cols))}


class K2Treap:
    """The tree of :func:`pack`, for searching. A cell -1 is none: without children, value 0."""

    def __init__(self, packed: dict, columns: int):
        self.side, self.columns = packed["side"], columns
        kids = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed["kids"]), np.uint8)
        ones = _ONES[kids]
        self.kids = np.append(kids, np.uint8(0)).astype(np.int32)
        self.first = np.append(1 + np.cumsum(ones) - ones, 0).astype(np.int32)
        top, at, inner = _unpacked(packed["lacks"]), 0, np.repeat(np.arange(len(kids)), ones)
        for size in packed["levels"]:
            if at:
                top[at : at + size] = top[inner[at - 1 : at - 1 + size]] - top[at : at + size]
            at += size
        self.top = np.append(top, 0).astype(np.int64)
        self.row, self.col = np.full(len(kids) + 1, -1, np.int32), np.full(len(kids) + 1, -1, np.int32)
        leaves = np.flatnonzero(kids == 0)
        self.row[leaves], self.col[leaves] = _unpacked(packed["rows"]), _unpacked(packed["cols"])

    def _step(self, cells: np.ndarray, rows: np.ndarray, shift, right: int) -> np.ndarray:
        """Children of ``cells`` on the paths of ``rows``, in the left or right half of the columns; a leaf is its own child."""
        kids = self.kids[cells]
        which = 2 * ((rows >> shift) & 1) + right
        child = np.where((kids >> which) & 1, self.first[cells] + _ONES[kids & ((1 << which) - 1)], -1)
        leaf = self.row[cells] >= 0
        child = np.where(leaf & (((self.col[cells] >> shift) & 1) == right), cells, child)
        other = self.row[child]
        return np.where((other >= 0) & (other != rows), -1, child)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row's path that spans all columns and as few rows as such a cell has."""
        cells = np.zeros(len(rows), np.int32)
        if self.row[0] >= 0:  # one point in all
            cells = np.where(self.row[0] == rows, cells, -1)
        for shift in range(self.side - 1, max(self.columns - 1, 0).bit_length() - 1, -1):
            cells = self._step(cells, rows, shift, 0)
        return cells

    def best(self, rows: np.ndarray, weights: np.ndarray, roots: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """``(column, score)`` of the ``k`` columns of greatest weighted sums of at least ``least``, equal ones by ascending column."""
        bits = max(self.columns - 1, 0).bit_length()
        bound = np.array([self.top[roots] @ weights], dtype=np.int64)
        cells, low, depth = roots[None, :], np.zeros(1, np.int64), np.zeros(1, np.int64)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            keep = bound >= least
            if not keep.all():
                cells, low, depth, bound = cells[keep], low[keep], depth[keep], bound[keep]
            if not len(bound):
                return columns, scores
            if len(bound) > WIDTH:
                ahead = np.zeros(len(bound), bool)
                ahead[np.argpartition(bound, len(bound) - WIDTH)[-WIDTH:]] = True
            else:
                ahead = np.ones(len(bound), bool)
            done = ahead & (depth == bits)
            if done.any():
                columns, scores = np.append(columns, low[done]), np.append(scores, bound[done])
                order = np.lexsort((columns, -scores))[:k]
                columns, scores = columns[order], scores[order]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))  # an equal score may be an earlier column's
            split = ahead & ~done
            rest = ~ahead
            parts = [(cells[rest], low[rest], depth[rest], bound[rest])]
            if split.any():
                shift = bits - 1 - depth[split]
                for right in (0, 1):
                    child = self._step(cells[split], rows[None, :], shift[:, None], right)
                    parts.append((child, low[split] + (right << shift), depth[split] + 1, self.top[child] @ weights))
            cells, low, depth, bound = (np.concatenate(x) for x in zip(*parts, strict=True))
