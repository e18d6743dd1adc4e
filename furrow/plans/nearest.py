"""Nearest of many places in the plane, exact and with ties in order, in numpy.

Places stand along a Morton curve in leaves of eight, under a tree of boxes.
A question first looks at the places around it on the curve.  Then all go down
the tree together: a box stays with a question while its near corner is no
farther than the nearest place so far and the least far corner of its boxes.
Rounding is monotone, so no distance passes the one worked out for its box.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
BRANCH = 4
QUESTIONS = 4096  # asked together, which bounds the memory

_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
           (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """31 bits of each value's share of the way from ``low`` to ``high``, with a gap behind every bit."""
    share = np.clip((values - low) / (high - low), 0, 1) if high > low else np.zeros(len(values))
    out = (share * (2**31 - 1)).astype(np.uint64)
    for shift, mask in _SPREAD:
        out = (out | out << np.uint64(shift)) & np.uint64(mask)
    return out


class Tree:
    """Boxes over the places (x, y); a place is known by its position."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.ends = x.min(), x.max(), y.min(), y.max()
        codes = self._codes(x, y)
        self.order = np.argsort(codes, kind="stable")
        self.codes, self.x, self.y = codes[self.order], x[self.order], y[self.order]
        boxes = [self.x, self.x, self.y, self.y]
        self.levels, width = [], LEAF
        while not self.levels or len(boxes[0]) > 1:
            cuts = np.arange(0, len(boxes[0]), width)
            boxes = [f.reduceat(b, cuts) for f, b in zip((np.minimum, np.maximum) * 2, boxes)]
            self.levels.append(boxes)
            width = BRANCH

    def _codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _spread(x, *self.ends[:2]) << np.uint64(1) | _spread(y, *self.ends[2:])

    def nearest(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Position of the place nearest to each (x, y), the first of equally near ones.

        -1 where no square of a distance is up to ``most``.
        """
        out = np.full(len(x), -1)
        for lo in range(0, len(x), QUESTIONS):
            part = slice(lo, lo + QUESTIONS)
            self._ask(x[part], y[part], most[part].copy(), out[part])
        return out

    def _ask(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, out: np.ndarray) -> None:
        there = np.searchsorted(self.codes, self._codes(x, y))
        for step in range(-LEAF // 2, LEAF // 2):
            at = np.clip(there + step, 0, len(self.x) - 1)
            gap_x, gap_y = self.x[at] - x, self.y[at] - y
            np.minimum(most, gap_x * gap_x + gap_y * gap_y, out=most)
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for x0, x1, y0, y1 in reversed(self.levels):
            if len(x0) > 1:
                who, node = _below(who, node, BRANCH, len(x0))
            if not len(who):
                return
            left, right, down, up = x0[node] - x[who], x1[node] - x[who], y0[node] - y[who], y1[node] - y[who]
            far = np.maximum(left * left, right * right) + np.maximum(down * down, up * up)
            cuts = _starts(who)
            most[who[cuts]] = np.minimum(most[who[cuts]], np.minimum.reduceat(far, cuts))
            gap_x = np.maximum(np.maximum(left, -right), 0.0)
            gap_y = np.maximum(np.maximum(down, -up), 0.0)
            stay = gap_x * gap_x + gap_y * gap_y <= most[who]
            who, node = who[stay], node[stay]
        who, node = _below(who, node, LEAF, len(self.x))
        gap_x, gap_y = self.x[node] - x[who], self.y[node] - y[who]
        d = gap_x * gap_x + gap_y * gap_y
        close = d <= most[who]
        who, d, node = who[close], d[close], self.order[node[close]]
        if not len(who):
            return
        cuts = _starts(who)
        least = np.repeat(np.minimum.reduceat(d, cuts), np.diff(cuts, append=len(who)))
        out[who[cuts]] = np.minimum.reduceat(np.where(d == least, node, len(self.x)), cuts)


def _below(who: np.ndarray, node: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    who = np.repeat(who, width)
    node = (node[:, None] * width + np.arange(width)).ravel()
    there = node < count
    return who[there], node[there]


def _starts(who: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(who), bool)
    new[1:] = who[1:] != who[:-1]
    return np.flatnonzero(new)
