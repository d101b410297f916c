"""The room that holds most points of a stroke, as a kernel over rows that come cell by cell.

Rooms of a cell are tried in their order, and a stroke that a room holds whole is done: a later room can't
hold more of it.  So where rooms lie one over the other few of them are tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from plinth.operators.cuts import starts_of, whole_groups

#: Pairs of rooms and points, and rooms, that are tried at once.
HELD, ROOMS = 1 << 16, 16
#: The columns after the keys: the cell, rooms (0) before strokes (1), the room or the stroke, its corners or points.
COLUMNS = ("cx", "cy", "kind", "room", "stroke", "xs", "ys")


def owners(keys: int, held: int = HELD) -> Callable:
    """Rows ``(key..., *COLUMNS)``, cell by cell, rooms in order, to ``(key..., stroke, room, inside)``: for strokes
    with a point in the cell the first of the rooms there that hold most of their points, if half of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys + 2):
            starts = starts_of(rows, keys + 2)
            kind, room, stroke, xs, ys = (rows.column(keys + k) for k in range(2, len(COLUMNS)))
            strokes = kind.to_numpy(zero_copy_only=False) == 1
            n = xs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.append(0, np.cumsum(n))
            x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in (xs, ys))
            of, best, most = [], [], []
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                first = a + int(np.count_nonzero(~strokes[a:b]))
                if a < first < b:
                    own, inside = _best(x, y, n, at, a, first, b, held)
                    enough = np.flatnonzero(inside >= np.maximum(1, n[first:b] // 2))
                    of.append(first + enough)
                    best.append(a + own[enough])
                    most.append(inside[enough])
            if sum(map(len, of)):
                of, best = pa.array(np.concatenate(of)), pa.array(np.concatenate(best))
                values = [*[c.take(of) for c in rows.columns[:keys]], stroke.take(of), room.take(best), pa.array(np.concatenate(most))]
                yield pa.RecordBatch.from_arrays(values, [*rows.schema.names[:keys], "stroke", "room", "inside"])

    return run


def _best(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, a: int, first: int, b: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the strokes first to b the number of its first best room of a to first, and its points in that."""
    corners = slice(at[a], at[first])
    begins = at[a:first] - at[a]
    box = [f.reduceat(c[corners], begins) for f in (np.fmin, np.fmax) for c in (x, y)]
    own, inside = np.zeros(b - first, np.int64), np.zeros(b - first, np.int64)
    left = np.flatnonzero(n[first:b] > 0)
    r = 0
    while r < first - a and len(left):
        count = n[first + left]
        of = np.repeat(np.arange(len(left)), count)
        points = np.repeat(at[first + left] - np.cumsum(count) + count, count) + np.arange(len(of))
        px, py = x[points], y[points]
        # the same strokes meet some rooms before those that are done leave
        until = min(first - a, r + max(1, min(ROOMS, held // len(of))))
        x0, y0, x1, y1 = (c[r:until, None] for c in box)
        room, point = np.nonzero((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
        hit = _in_ring(px[point], py[point], x, y, at[a + r : a + until][room], n[a + r : a + until][room])
        counts = np.bincount(room[hit] * len(left) + of[point[hit]], minlength=(until - r) * len(left)).reshape(until - r, len(left))
        now, which = counts.max(axis=0), counts.argmax(axis=0)
        more = now > inside[left]
        own[left[more]], inside[left[more]] = r + which[more], now[more]
        left = left[inside[left] < count]
        r = until
    return own, inside


def _in_ring(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each point lies in its ring of ``size`` corners from ``start`` on, by the rule of point_in_polygon."""
    odd = np.zeros(len(px), bool)
    if not len(px):
        return odd
    for k in range(int(size.max())):
        some = np.flatnonzero(k < size) if (size <= k).any() else slice(None)
        own, u, v = start[some], px[some], py[some]
        i, j = own + k, own + np.where(k + 1 < size[some], k + 1, 0)
        ax, ay, bx, by = x[i], y[i], x[j], y[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            odd[some] ^= ((ay > v) != (by > v)) & (u < ax + (v - ay) * (bx - ax) / (by - ay))
    return odd
