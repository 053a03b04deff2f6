"""Banded alignment: word edit distances of many pairs at once, exact up to each pair's limit."""

from __future__ import annotations

import numpy as np

#: Cells (pairs x band) of one row that are worked on together.
CELLS = 1 << 18
FIRST_BAND = 8


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edit distances of the word sequences, -1 where a distance exceeds its limit.

    Common ends are cut off, bags of words bound the distance from below, and bands widen fourfold until the distance
    lies inside (then it is exact) or the band has reached the limit.
    """
    out = np.full(len(pairs), -1, np.int64)
    left: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(pairs):
        a, b = _trim(a, b)
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limits[i]:
            continue
        if not len(a):
            out[i] = len(b)
        elif _bag_bound(a, b) <= limits[i]:
            left.append((i, a, b))
    band = FIRST_BAND
    while left:
        left.sort(key=lambda x: len(x[1]))
        again, group = [], []
        for k, item in enumerate(left):
            group.append(item)
            width = 2 * min(band, int(max(limits[g[0]] for g in group))) + 1
            full = len(group) * width >= CELLS or k + 1 == len(left) or len(left[k + 1][1]) > 2 * len(group[0][1]) + 32
            if full:
                tops = np.array([min(band, int(limits[g[0]])) for g in group])
                found = _band([g[1] for g in group], [g[2] for g in group], int(tops.max()))
                for g, top, d in zip(group, tops, found):
                    if d <= top:
                        out[g[0]] = d
                    elif top < limits[g[0]]:
                        again.append(g)
                group = []
        left, band = again, band * 4
    return out


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    return a, b


def _bag_bound(a: np.ndarray, b: np.ndarray) -> int:
    """max(|A - B|, |B - A|) of the bags of words: no alignment has fewer edits."""
    both, sign = np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    order = np.argsort(both, kind="stable")
    both, sign = both[order], sign[order]
    net = np.add.reduceat(sign, np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])))
    return int(max(net[net > 0].sum(), -net[net < 0].sum()))


def _band(lefts: list[np.ndarray], rights: list[np.ndarray], t: int) -> np.ndarray:
    """Distances of all pairs in the band |j - i| <= t; at most t is exact, more means more than t."""
    p, width = len(lefts), 2 * t + 1
    n, m = np.array([len(a) for a in lefts]), np.array([len(b) for b in rights])
    rows = int(n.max())
    # padded so that b[i + k - t] can be read as one slice; the pads of a and b differ and match nothing
    a = np.zeros((p, rows), np.uint32)
    b = np.zeros((p, rows + width + 1), np.uint32)
    ma, mb = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(lefts, rights)):
        a[k, : len(x)], ma[k, : len(x)] = x, True
        y = y[: rows + width + 1 - t]
        b[k, t : t + len(y)], mb[k, t : t + len(y)] = y, True
    big, slope = np.int32(1 << 28), np.arange(width, dtype=np.int32)
    d = np.where(slope >= t, slope - t, big).astype(np.int32)[None].repeat(p, 0)  # row 0: d(0, j) = j
    out = np.full(p, big, np.int32)
    ends = m - n + t
    for i in range(1, rows + 1):
        # cell k is column j = i + k - t: diagonal d[k], above d[k + 1], left of it in this row
        cost = ~((b[:, i - 1 : i - 1 + width] == a[:, i - 1 : i]) & mb[:, i - 1 : i - 1 + width] & ma[:, i - 1 : i])
        new = d + cost
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        if i <= t:
            new[:, t - i] = i  # column 0
            new[:, : t - i] = big
        new = np.minimum.accumulate(new - slope, axis=1) + slope
        d = np.minimum(new, big)
        ended = np.flatnonzero(n == i)
        if len(ended):
            ok = ends[ended] < width
            out[ended[ok]] = d[ended[ok], ends[ended[ok]]]
    return out
