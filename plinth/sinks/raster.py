"""A small canvas, palettes and an animated GIF writer."""

from __future__ import annotations

import heapq
import struct
from functools import cache, lru_cache, reduce
from operator import itemgetter

import numpy as np

# Colours of room categories; those without one of their own are "unknown".
CATEGORY_COLOURS = {
    "living": (232, 168, 90), "bedroom": (126, 168, 219), "kitchen": (226, 122, 110), "bathroom": (120, 199, 191), "dining": (214, 148, 196),
    "balcony": (168, 205, 130), "hall": (176, 180, 194), "stairs": (200, 178, 140), "storage": (158, 166, 190), "office": (150, 160, 220),
    "garage": (154, 154, 154), "worship": (208, 168, 88), "technical": (140, 150, 155), "other": (185, 190, 200), "unknown": (205, 207, 213),
}
MATERIAL_COLOURS = ((198, 122, 96), (146, 152, 168), (206, 178, 118), (128, 168, 148), (176, 138, 178), (150, 160, 200))
KIND_COLOURS = {"door": (196, 90, 60), "window": (70, 130, 190), "opening": (120, 120, 120)}
INK, PAPER, MUTED = (40, 42, 48), (250, 250, 247), (150, 150, 150)
Colour = tuple[int, int, int]
# Glyphs of ids and areas in the usual 5 x 7 character-generator shapes, a row's bits from left to right.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12), ".": (0, 0, 0, 0, 0, 12, 12), "-": (0, 0, 0, 31, 0, 0, 0),
    "R": (30, 17, 17, 30, 20, 18, 17), "O": (14, 17, 17, 17, 17, 17, 14), "W": (17, 17, 17, 21, 21, 21, 10), "M": (17, 27, 21, 21, 17, 17, 17),
}


def colour_for(category: str) -> Colour:
    return CATEGORY_COLOURS.get(category, CATEGORY_COLOURS["unknown"])


def material_colour(i: int) -> Colour:
    return MATERIAL_COLOURS[i % len(MATERIAL_COLOURS)]


def kind_colour(kind: str) -> Colour:
    return KIND_COLOURS.get(kind, MUTED)


def hex_of(c: Colour) -> str:
    return "#" + bytes(c).hex()


def mix(a: Colour, b: Colour, t: float) -> Colour:
    t = min(1.0, max(0.0, t))
    return tuple(round(x + (y - x) * t) for x, y in zip(a, b, strict=True))


@lru_cache(4)
def _grid(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The middles of pixels: their ys and xs, not to be changed."""
    return tuple(np.mgrid[0:height, 0:width] + 0.5)


class Canvas:
    """``covers`` holds what a shape covers, for frames that draw the same shapes in other colours."""

    def __init__(self, width: int, height: int, paper: Colour = PAPER, covers: dict | None = None):
        self.pixels = np.full((height, width, 3), paper, np.uint8)
        self.covers = {} if covers is None else covers
        self.ys, self.xs = _grid(width, height)

    def _cover(self, shape: tuple, make):
        if shape not in self.covers:
            self.covers[shape] = make()
        return self.covers[shape]

    def _box(self, x0: float, y0: float, x1: float, y1: float) -> tuple[slice, slice] | None:
        h, w = self.xs.shape
        cols, rows = slice(max(0, int(x0)), min(w, int(x1) + 1)), slice(max(0, int(y0)), min(h, int(y1) + 1))
        return (rows, cols) if cols.start < cols.stop and rows.start < rows.stop else None

    def _blend(self, box: tuple[slice, slice] | None, cover: np.ndarray | None, colour: Colour, strength: float = 1.0) -> None:
        """Outside its box a shape covers nothing."""
        if box is not None:
            part, cover = self.pixels[box], (cover * strength)[..., None]
            part[:] = np.rint(part * (1 - cover) + np.array(colour) * cover)

    def _polygon(self, points: tuple) -> tuple:
        px, py = [p[0] for p in points], [p[1] for p in points]
        box = self._box(min(px) - 1, min(py) - 1, max(px) + 1, max(py) + 1) if points else None
        if box is None:
            return None, None
        ys, xs = self.ys[box], self.xs[box]
        inside = np.zeros(xs.shape, bool)
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay != by:
                inside ^= ((ay > ys) != (by > ys)) & (xs < ax + (ys - ay) * (bx - ax) / (by - ay))
        return box, inside

    def polygon(self, points: list[tuple[float, float]], colour: Colour, strength: float = 1.0) -> None:
        """Even-odd fill."""
        shape = tuple(points)
        self._blend(*self._cover(("polygon", shape), lambda: self._polygon(shape)), colour, strength)

    def _line(self, a: tuple[float, float], b: tuple[float, float], width: float) -> tuple:
        r = width / 2 + 1
        box = self._box(min(a[0], b[0]) - r, min(a[1], b[1]) - r, max(a[0], b[0]) + r, max(a[1], b[1]) + r)
        if box is None:
            return None, None
        dx, dy = b[0] - a[0], b[1] - a[1]
        xs, ys = self.xs[box] - a[0], self.ys[box] - a[1]
        t = np.clip((xs * dx + ys * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
        return box, np.clip(width / 2 + 0.5 - np.hypot(xs - t * dx, ys - t * dy), 0, 1)

    def line(self, a: tuple[float, float], b: tuple[float, float], colour: Colour, width: float = 1.5) -> None:
        """With soft edges, over the line's own box only."""
        self._blend(*self._cover(("line", a, b, width), lambda: self._line(a, b, width)), colour)

    def text(self, x: float, y: float, said: str, colour: Colour, size: int = 1) -> None:
        """Centred at (x, y); characters without a glyph leave a blank."""
        left, top = int(x - 3 * size * len(said)), int(y - 3.5 * size)
        for k, c in enumerate(said.upper()):
            for row, bits in enumerate(GLYPHS.get(c, ())):
                for col in range(5):
                    if bits >> (4 - col) & 1:
                        px, py = left + (6 * k + col) * size, top + row * size
                        if px >= 0 and py >= 0:
                            self.pixels[py : py + size, px : px + size] = colour

    def _round(self, x: float, y: float, radius: float, cover) -> tuple:
        box = self._box(x - radius - 2, y - radius - 2, x + radius + 2, y + radius + 2)
        return box, None if box is None else np.clip(cover(np.hypot(self.xs[box] - x, self.ys[box] - y)), 0, 1)

    def _ring(self, x: float, y: float, radius: float, width: float) -> tuple:
        return self._round(x, y, radius + width, lambda far: width / 2 + 0.5 - np.abs(far - radius))

    def ring(self, x: float, y: float, radius: float, colour: Colour, width: float = 1.5) -> None:
        self._blend(*self._cover(("ring", x, y, radius, width), lambda: self._ring(x, y, radius, width)), colour)

    def _circle(self, x: float, y: float, radius: float) -> tuple:
        return self._round(x, y, radius, lambda far: radius + 0.5 - far)

    def circle(self, x: float, y: float, radius: float, colour: Colour) -> None:
        self._blend(*self._cover(("circle", x, y, radius), lambda: self._circle(x, y, radius)), colour)


class Film:
    """Frames of one size that show the same shapes in other colours: each shape is laid on all frames that show
    it at once, with the results of a :class:`Canvas` for each.  ``colours`` are those of the last frames."""

    def __init__(self, width: int, height: int, frames: int, paper: Colour = PAPER):
        self.canvas = Canvas(width, height)
        self.pixels = np.full((width * height, frames), _number(paper), np.uint32)

    def _lay(self, shape: tuple, make, colours: list[Colour]) -> None:
        """What a shape covers wholly takes its colour, what it covers in part is blended, the rest stays."""
        if not colours:
            return
        own = self.pixels[:, -len(colours) :]
        whole, part, cover = self.canvas._cover(("laid", *shape), lambda: self._split(*make()))
        if len(whole):
            own[whole] = [_number(c) for c in colours]
        if len(part):
            own[part] = _packed(np.rint(_unpacked(own[part]) * (1 - cover) + np.array(colours) * cover))

    def _split(self, box: tuple[slice, slice] | None, cover: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the pixels that are covered wholly and in part, and by how much."""
        none = np.zeros(0, np.int64)
        if box is None:
            return none, none, none
        rows, cols = box
        at = (np.arange(rows.start, rows.stop)[:, None] * self.canvas.xs.shape[1] + np.arange(cols.start, cols.stop)).ravel()
        flat = cover.ravel() * 1.0
        soft = (flat > 0) & (flat < 1)
        return at[flat >= 1], at[soft], flat[soft][:, None, None]

    def polygon(self, points: list[tuple[float, float]], colours: list[Colour]) -> None:
        shape = tuple(points)
        self._lay(("polygon", shape), lambda: self.canvas._polygon(shape), colours)

    def line(self, a: tuple[float, float], b: tuple[float, float], colours: list[Colour], width: float = 1.5) -> None:
        self._lay(("line", a, b, width), lambda: self.canvas._line(a, b, width), colours)

    def ring(self, x: float, y: float, radius: float, colours: list[Colour], width: float = 1.5) -> None:
        self._lay(("ring", x, y, radius, width), lambda: self.canvas._ring(x, y, radius, width), colours)

    def circle(self, x: float, y: float, radius: float, colours: list[Colour]) -> None:
        self._lay(("circle", x, y, radius), lambda: self.canvas._circle(x, y, radius), colours)

    def text(self, x: float, y: float, said: str, colours: list[Colour]) -> None:
        height, width = self.canvas.xs.shape
        left, top = int(x - 3 * len(said)), int(y - 3.5)
        dots = [(left + 6 * k + col, top + row) for k, c in enumerate(said.upper()) for col, row in _dots(c)]
        at = [py * width + px for px, py in dots if 0 <= px < width and 0 <= py < height]
        if at and colours:
            self.pixels[at, -len(colours) :] = [_number(c) for c in colours]

    def shown(self) -> list[np.ndarray]:
        each = _unpacked(self.pixels).astype(np.uint8).reshape(*self.canvas.xs.shape, -1, 3)
        return [each[:, :, k] for k in range(each.shape[2])]

    def gif(self, delays: list[int]) -> bytes:
        return _gif(self.pixels, *self.canvas.xs.shape, delays)


def _number(c: Colour) -> int:
    return c[0] << 16 | c[1] << 8 | c[2]


@cache
def _dots(character: str) -> tuple[tuple[int, int], ...]:
    """Column and row of a glyph's dots."""
    return tuple((col, row) for row, bits in enumerate(GLYPHS.get(character, ())) for col in range(5) if bits >> (4 - col) & 1)


def _packed(pixels: np.ndarray) -> np.ndarray:
    """Each colour as one number."""
    p = pixels.astype(np.uint32)
    return (p[..., 0] << 16) | (p[..., 1] << 8) | p[..., 2]


def _runs(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each colour as one number, and how often it stands in a row: drawings are mostly flat."""
    packed = _packed(pixels.reshape(-1, 3))
    starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
    return packed[starts], np.diff(starts, append=len(packed))


def _unpacked(colours: np.ndarray) -> np.ndarray:
    return np.stack([colours >> 16 & 255, colours >> 8 & 255, colours & 255], axis=-1).astype(np.int64)


def median_cut(pixels: np.ndarray, most: int = 256) -> np.ndarray:
    """At most ``most`` colours: the box with the widest channel is cut at its middle."""
    values, lengths = _runs(pixels)
    found, back = np.unique(values, return_inverse=True)
    return _cut(found, np.bincount(back.ravel(), weights=lengths, minlength=len(found)).astype(np.int64), most)


def _cut(found: np.ndarray, counts: np.ndarray, most: int = 256) -> np.ndarray:
    def box(number: int, rows: list[tuple]) -> tuple:
        if len(rows) == 1:
            return 0, number, 0, rows
        if len(rows) == 2:
            (r, g, b, _), (u, v, w, _) = rows
            spans = (abs(r - u), abs(g - v), abs(b - w))
        else:
            red, green, blue, _ = zip(*rows)
            spans = (max(red) - min(red), max(green) - min(green), max(blue) - min(blue))
        widest = max(spans)
        return -widest, number, spans.index(widest), rows  # the widest first, then the older

    # rows of red, green, blue and count: boxes are many and small
    boxes, made = [box(0, [(*c, n) for c, n in zip(_unpacked(found).tolist(), counts.tolist(), strict=True)])], 1
    while len(boxes) < most and boxes[0][0] < 0:
        _, _, channel, rows = heapq.heappop(boxes)
        rows = sorted(rows, key=_CHANNEL[channel])
        at = 1
        if len(rows) > 2:
            half, seen, at = sum(map(_COUNT, rows)) / 2, 0, 0
            while (seen := seen + rows[at][3]) < half:
                at += 1
            at = min(max(1, at), len(rows) - 1)
        heapq.heappush(boxes, box(made, rows[:at]))
        heapq.heappush(boxes, box(made + 1, rows[at:]))
        made += 2
    mean = lambda rows, k: round(sum(r[k] * r[3] for r in rows) / sum(r[3] for r in rows))
    return np.array([rows[0][:3] if len(rows) == 1 else [mean(rows, k) for k in range(3)] for _, _, _, rows in boxes], np.uint8)


_CHANNEL, _COUNT = tuple(map(itemgetter, range(3))), itemgetter(3)


def _closest(found: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The number in the palette for each packed colour; of two as near the first."""
    # all that enters is whole and under 2^24, so the products of floats are exact
    own, their = _unpacked(found).astype(np.float64), palette.astype(np.float64)
    far = (own * own).sum(axis=1)[:, None] - 2 * (own @ their.T) + (their * their).sum(axis=1)
    return far.argmin(axis=1)


def nearest(pixels: np.ndarray, palette: np.ndarray) -> np.ndarray:
    values, lengths = _runs(pixels)
    found, back = np.unique(values, return_inverse=True)
    return np.repeat(_closest(found, palette)[back.ravel()], lengths).astype(np.uint8)


def lzw(indices: bytes, bits: int) -> bytes:
    """GIF's variable-width codes, packed from the low bit."""
    data = np.frombuffer(indices, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]])) if len(data) else np.zeros(0, np.int64)
    return _pack(_codes(data[starts].tolist(), np.diff(starts, append=len(data)).tolist(), bits), bits)


def _codes(indices: list[int], lengths: list[int], bits: int) -> list[int]:
    """The codes of indices that stand so often in a row."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes = [clear]
    # a string is its code; how it goes on with 1, 2, ... of one index is found by both, so flat parts are
    # taken in one step; before a string begins its code is -1
    fresh = lambda: {i - 256: [i] for i in set(indices)}
    table, known, run = fresh(), end + 1, -1
    add = codes.append
    for i, left in zip(indices, lengths, strict=True):
        longer = table.get(run << 8 | i)
        if longer is None:
            longer = table[run << 8 | i] = []
        while left > (n := len(longer)):
            if n:
                run, left = longer[-1], left - n
            add(run)
            if known < 4096:
                longer.append(known)
                known += 1
            else:
                add(clear)
                table, known = fresh(), end + 1
            longer = table[i - 256]
        run = longer[left - 1]
    if run >= 0:
        add(run)
    add(end)
    return codes


def _pack(codes: list[int], bits: int) -> bytes:
    clear, every = 1 << bits, np.array(codes, np.int64)
    # after a clear code the first code is as wide as before, and each adds a string until there are 4096
    at = np.arange(len(every))
    since = at - np.maximum.accumulate(np.where(every == clear, at, 0))
    sizes = np.full(len(every), bits + 1)
    for width in range(bits + 1, 12):
        sizes += since > (1 << width) - clear - 1
    # a clear code is written at the width that the codes before it have reached
    again = np.flatnonzero(every == clear)[1:]
    sizes[again] = sizes[again - 1]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.packbits((np.repeat(every, sizes) >> place & 1).astype(np.uint8), bitorder="little").tobytes()


def gif(frames: list[tuple[np.ndarray, int]]) -> bytes:
    """A looping GIF of (pixels, hundredths of a second) frames with one palette."""
    if not frames:
        raise ValueError("no frames")
    return _gif(np.stack([_packed(f).ravel() for f, _ in frames], axis=1), *frames[0][0].shape[:2], [delay for _, delay in frames])


def _gif(packed: np.ndarray, h: int, w: int, delays: list[int]) -> bytes:
    """``packed`` holds a pixel's colour in each frame.

    Frames show the same shapes, so where all of them stay the same from a pixel to the next is found once.
    Frames with the same parts in other colours are parsed once: only what stands for single indices differs.
    """
    turns = reduce(np.logical_or, [packed[1:, k] != packed[:-1, k] for k in range(len(delays))])
    starts = np.flatnonzero(np.concatenate([[True], turns]))
    packed, lengths = packed[starts].T, np.diff(starts, append=len(packed))
    found = np.unique(packed)
    back = np.searchsorted(found, packed)
    counts = np.bincount(back.ravel(), weights=np.tile(lengths, len(delays)), minlength=len(found)).astype(np.int64)
    palette = _cut(found, counts)
    bits = max(2, int(len(palette) - 1).bit_length())
    full = np.zeros((1 << bits, 3), np.uint8)
    full[: len(palette)] = palette
    closest = _closest(found, palette)
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0 | (bits - 1), 0, 0) + full.tobytes()
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    parsed: dict = {}
    for own, delay in zip(closest[back], delays, strict=True):
        turns = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        data = _coded(own[turns], np.add.reduceat(lengths, turns), bits, parsed)
        out += b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([bits])
        out += b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    return out + b";"


def _coded(indices: np.ndarray, lengths: np.ndarray, bits: int, parsed: dict) -> bytes:
    """The data of a frame; ``parsed`` has the codes of frames with indices numbered as they come."""
    first = np.full(256, len(indices))
    first[indices[::-1]] = np.arange(len(indices))[::-1]
    order = np.argsort(first)
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    pattern = rank[indices]
    key = pattern.astype(np.uint8).tobytes(), lengths.tobytes()
    if key not in parsed:
        parsed[key] = np.array(_codes(pattern.tolist(), lengths.tolist(), bits), np.int64)
    codes, back = parsed[key], np.arange(4096)
    back[: 1 << bits] = order[: 1 << bits]
    return _pack(back[codes], bits)
