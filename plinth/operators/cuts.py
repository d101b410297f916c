"""Where segments of a grid cell are cut, as a kernel over rows that come cell by cell.

In a crowd nearly all the work is to try pairs, so pairs are tried in blocks of numbers, and cuts are taken
together before they leave the kernel: of cuts that follow each other closely the first and last stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plinth.functions.geometry import EPS, ON

#: Pairs, and shares of segments, that are held at once.
HELD = 1 << 15
#: Cells of so many segments are tried whole, as a square of numbers.
CROWD = 64
#: Of ``tol``; pieces of that length are surely too short to stay.
SHARE = 0.99
#: The columns after the keys: the cell, the segment, its ends and its length.
COLUMNS = ("cx", "cy", "seg", "ax", "ay", "bx", "by", "length")


def cut_runs(keys: int, tol: float, size: float, held: int = HELD) -> Callable:
    """Rows ``(key..., *COLUMNS)``, cell by cell, to ``(key..., seg, lo, hi)``: the runs of cuts of each segment, in
    shares of its length, by the crossings in the cell and by the ends of others in it that are at most
    ``tol`` off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys + 2):
            yield from _runs(rows, keys, tol, size, held)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """The same rows, so that rows with equal first columns, which follow each other, are in one batch."""
    waiting: list[pa.RecordBatch] = []  # of a group that may go on
    for batch in batches:
        if not len(batch):
            continue
        last = starts_of(batch, first)[-1]
        if waiting and not _same(waiting[-1], batch, first):
            yield pa.concat_batches(waiting)
            waiting = []
        if last:
            yield pa.concat_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.concat_batches(waiting)


def starts_of(rows: pa.RecordBatch, first: int) -> np.ndarray:
    """Where the values of the first columns change."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for column in rows.columns[:first]:
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _same(one: pa.RecordBatch, two: pa.RecordBatch, first: int) -> bool:
    return all(a[len(one) - 1].as_py() == b[0].as_py() for a, b in zip(one.columns[:first], two.columns[:first], strict=True))


def _blocks(low: np.ndarray, high: np.ndarray, extra: np.ndarray, held: int) -> Iterator[tuple]:
    """Row i meets all from low[i] to high[i]: (first row, last, i, j) with up to ``held`` pairs and extras."""
    n = high - low
    cost, row = np.cumsum(n + extra), 0
    while row < len(n):
        stop = max(row + 1, int(np.searchsorted(cost, held + (cost[row - 1] if row else 0), "right")))
        own = n[row:stop]
        i = np.repeat(np.arange(row, stop), own)
        j = np.arange(len(i)) + np.repeat(low[row:stop] - np.cumsum(own) + own, own)
        yield row, stop, i, j
        row = stop


def _ranges(low: np.ndarray, high: np.ndarray, extra: np.ndarray, starts: np.ndarray, held: int, near: Callable) -> Iterator[tuple]:
    """As :func:`_blocks` for rows in cells that begin at ``starts``; of a crowd only the pairs for which ``near(first, stop,
    low, high)`` holds, a square of first to stop by low to high.  ``near`` may hold for more than what meets."""
    stops = np.append(starts[1:], len(low))
    crowds = np.flatnonzero(stops - starts >= CROWD)
    done = 0
    for c in [*crowds.tolist(), None]:
        upto = len(low) if c is None else int(starts[c])
        for first, stop, i, j in _blocks(low[done:upto], high[done:upto], extra[done:upto], held):
            yield done + first, done + stop, done + i, j
        if c is None:
            return
        done, a, b = int(stops[c]), int(low[upto]), int(high[upto])
        cost, row = np.cumsum(extra[upto:done] + (b - a)), upto
        while row < done and b > a:
            stop = upto + max(row - upto + 1, int(np.searchsorted(cost, held + (cost[row - upto - 1] if row > upto else 0), "right")))
            i, j = np.divmod(np.flatnonzero(near(row, stop, a, b)), b - a)
            yield row, stop, row + i, a + j
            row = stop


def _runs(rows: pa.RecordBatch, keys: int, tol: float, size: float, held: int) -> Iterator[pa.RecordBatch]:
    starts = starts_of(rows, keys + 2)
    cx, cy, seg, ax, ay, bx, by, length = (rows.column(keys + k).to_numpy(zero_copy_only=False) for k in range(len(COLUMNS)))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    stops = np.append(starts[1:], len(rows))
    cell = np.repeat(np.arange(len(starts)), stops - starts)
    shares = np.floor(length / (SHARE * tol)).astype(np.int64) + 1

    def told(first: int, stop: int, i: np.ndarray, foot: np.ndarray) -> pa.RecordBatch | None:
        inner = (foot > tol / length[i]) & (foot < 1 - tol / length[i])
        i, foot = i[inner], foot[inner]
        if not len(i):
            return None
        own = shares[first:stop]
        at = (np.cumsum(own) - own)[i - first] + np.floor(foot * length[i] / (SHARE * tol)).astype(np.int64)
        low, high = np.full(own.sum(), np.inf), np.full(own.sum(), -np.inf)
        np.minimum.at(low, at, foot)
        np.maximum.at(high, at, foot)
        used = np.flatnonzero(low <= high)
        row, low, high = np.repeat(np.arange(first, stop), own)[used], low[used], high[used]
        begins = np.concatenate([[True], (row[1:] != row[:-1]) | ((low[1:] - high[:-1]) * length[row[1:]] > SHARE * tol)])
        begun = np.flatnonzero(begins)
        ended = np.append(begun[1:], len(row)) - 1
        taken = pa.array(row[begun])
        names = [*rows.schema.names[:keys], "seg", "lo", "hi"]
        return pa.RecordBatch.from_arrays([*[c.take(taken) for c in rows.columns[:keys]], rows.column(keys + 2).take(taken), pa.array(low[begun]), pa.array(high[ended])], names)

    # about the first corner of each cell, so that little is lost far from the origin
    mx, my = ax - ax[starts][cell], ay - ay[starts][cell]
    turn = mx * dy - my * dx

    def crosses(first: int, stop: int, low: int, high: int) -> np.ndarray:
        """Both ends of each are not clearly on one side of the other: s (s - 1) and t (t - 1) times the square of det
        are not clearly over 0, with room for rounding and for what is ON beyond the ends."""
        own, other = slice(first, stop), slice(low, high)
        reach = float(length[low:high].max())
        room = 1e-6 * reach**4 + 1e-12 * (float(np.abs(mx[other]).max()) + float(np.abs(my[other]).max()) + reach) ** 4
        px, py, qx, qy = dx[own, None], dy[own, None], dx[None, other], dy[None, other]
        det, part = px * qy, py * qx
        det -= part
        far, step = turn[None, other] - mx[own, None] * qy, my[own, None] * qx
        far += step
        np.subtract(far, det, out=part)
        part *= far
        held_s = part <= room
        np.multiply(py, mx[None, other], out=far)
        np.multiply(px, my[None, other], out=step)
        far -= step
        far -= turn[own, None]
        np.subtract(far, det, out=part)
        part *= far
        held_s &= part <= room
        return held_s

    for first, stop, i, j in _ranges(starts[cell], stops[cell], shares, starts, held, crosses):
        px, py, qx, qy = dx[i], dy[i], dx[j], dy[j]
        det, ex, ey = px * qy - py * qx, ax[j] - ax[i], ay[j] - ay[i]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            s = (ex * qy - ey * qx) / det
        on = np.flatnonzero((np.abs(det) >= EPS) & (s >= -ON) & (s <= 1 + ON))
        i, j, s = i[on], j[on], s[on]
        t = (ex[on] * py[on] - ey[on] * px[on]) / det[on]
        on = (t >= -ON) & (t <= 1 + ON)
        i, j, s, t = i[on], j[on], s[on], t[on]
        # the point is taken from the segment that comes first, as the two of them tell it
        own = seg[i] < seg[j]
        p, at = np.where(own, i, j), np.where(own, s, t)
        x, y = ax[p] + at * dx[p], ay[p] + at * dy[p]
        on = (np.floor(x / size) == cx[i]) & (np.floor(y / size) == cy[i])
        i, x, y = i[on], x[on], y[on]
        if (made := told(first, stop, i, ((x - ax[i]) * dx[i] + (y - ay[i]) * dy[i]) / square[i])) is not None:
            yield made
    # every end in the cell is one of a segment that runs through it
    x, y, of = np.concatenate([ax, bx]), np.concatenate([ay, by]), np.concatenate([cell, cell])
    here = (np.floor(x / size) == cx[starts][of]) & (np.floor(y / size) == cy[starts][of])
    x, y, of = x[here], y[here], of[here]
    order = np.lexsort((y, x, of))
    x, y, of = x[order], y[order], of[order]
    once = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(of) else np.zeros(0, np.int64)
    x, y, of = x[once], y[once], of[once]
    low, high = np.searchsorted(of, np.arange(len(starts))), np.searchsorted(of, np.arange(len(starts)), "right")
    ox, oy = x - ax[starts][of], y - ay[starts][of]

    def beside(first: int, stop: int, a: int, b: int) -> np.ndarray:
        off = dy[first:stop, None] * ox[None, a:b]
        off -= dx[first:stop, None] * oy[None, a:b]
        off -= turn[first:stop, None]
        scale = float(np.abs(ox[a:b]).max()) + float(np.abs(oy[a:b]).max()) + float(np.abs(mx[first:stop]).max()) + float(np.abs(my[first:stop]).max())
        return np.abs(off, out=off) <= (length[first:stop] * (tol * (1 + 1e-9) + 1e-12 * scale))[:, None]

    for first, stop, i, j in _ranges(low[cell], high[cell], shares, starts, held, beside):
        t = ((x[j] - ax[i]) * dx[i] + (y[j] - ay[i]) * dy[i]) / square[i]
        on = np.flatnonzero((t > 0) & (t < 1))
        i, j, t = i[on], j[on], t[on]
        on = np.hypot(ax[i] + dx[i] * t - x[j], ay[i] + dy[i] * t - y[j]) <= tol
        if (made := told(first, stop, i[on], t[on])) is not None:
            yield made
