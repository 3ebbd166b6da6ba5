"""Lossless WebP: a decoder of the whole format, and an encoder of grey samples by palette, references or differences."""

from __future__ import annotations

import heapq
import struct
from functools import cache

import numpy as np

# Fixed values of the format.
SIGNATURE = 0x2F
PREDICT, CROSS, GREEN, PALETTE = range(4)
LEFT, TOP = 1, 2  # modes of prediction
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MOST_SIDE = 1 << 14
LONGEST = 15


class Damaged(ValueError):
    """A file that isn't lossless WebP, or is cut off."""


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise Damaged("the stream is cut off")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


# --- prefix codes


@cache
def mirrored(width: int) -> np.ndarray:
    """Each number of so many bits with its bits in the other order."""
    n = np.arange(1 << width, dtype=np.int64)
    out = np.zeros_like(n)
    for _ in range(width):
        out, n = out << 1 | n & 1, n >> 1
    return out


def in_code_order(lengths: np.ndarray) -> np.ndarray:
    """The symbols of a code by length, then by number."""
    used = np.flatnonzero(lengths)
    return used[np.argsort(lengths[used], kind="stable")]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, with its first bit lowest, as the stream has it. Codes in order lie end to end: each
    begins where the shares of those before it end."""
    order = in_code_order(lengths)
    share = 1 << (LONGEST - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = mirrored(LONGEST)[(np.cumsum(share) - share) & ((1 << LONGEST) - 1)]
    return codes


class Prefix:
    """Look-up by the next `width` bits: symbol and length. A code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        order = in_code_order(lengths)
        if not len(order):
            raise Damaged("a prefix code without symbols")
        self.only = int(order[0]) if len(order) == 1 else None
        self.width = 0 if self.only is not None else int(lengths[order[-1]])
        self.most = int(order.max())
        if self.only is None:
            own = lengths[order]
            if (1 << (LONGEST - own)).sum() != 1 << LONGEST:
                raise Damaged("a prefix code that isn't complete")
            at, times = mirrored(self.width), 1 << (self.width - own)
            self.symbol = np.repeat(order.astype(np.uint16), times)[at]
            self.length = np.repeat(own.astype(np.uint8), times)[at]

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.peek(self.width)
        bits.at += int(self.length[k])
        if bits.at > bits.end:
            raise Damaged("the stream is cut off")
        return int(self.symbol[k])


def read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise Damaged("a symbol outside the alphabet")
        lengths[symbols] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code = Prefix(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        k = code.next(bits)
        if k < 16:
            lengths[at] = k
            last = k or last
            at += 1
            continue
        value, times = (last, 3 + bits.read(2)) if k == 16 else (0, 3 + bits.read(3)) if k == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise Damaged("code lengths run over")
        lengths[at : at + times] = value
        at += times
    return Prefix(lengths)


# --- entropy-coded pixels


def _value(code: int, bits: Bits) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _lone_channel(bits: Bits, code: Prefix, n: int) -> np.ndarray:
    """n symbols of one code, all bit places looked up at once and then strung together eight symbols at a step. In
    windows of bits, so that a large image takes bounded memory."""
    if code.only is not None:
        return np.full(n, code.only, np.uint16)
    data = np.frombuffer(bits.data, np.uint8)
    out, got, at = np.empty(n, np.uint16), 0, bits.at
    window, mask = 1 << 17, np.uint32((1 << code.width) - 1)
    while got < n:
        first = at >> 3
        part = np.zeros(min(window, len(data) - first) + 24, np.uint8)
        real = data[first : first + len(part)]
        part[: len(real)] = real
        if not len(real):
            raise Damaged("the stream is cut off")
        m = len(part) - 3
        word = part[:m].astype(np.uint32) | part[1 : m + 1].astype(np.uint32) << 8 | part[2 : m + 2].astype(np.uint32) << 16
        places = np.empty((m, 8), np.uint32)
        for s in range(8):
            np.bitwise_and(word >> np.uint32(s), mask, out=places[:, s])
        index = places.reshape(-1)
        one = code.length[index]
        total = len(index)
        stop = total - 8 * LONGEST - 1
        spot = np.arange(total, dtype=np.int32)
        two = one[:-LONGEST] + one[spot[:-LONGEST] + one[:-LONGEST]]
        cut = len(two) - 2 * LONGEST
        four = two[:cut] + two[spot[:cut] + two[:cut]]
        cut = len(four) - 4 * LONGEST
        eight = (four[:cut] + four[spot[:cut] + four[:cut]]).tobytes()
        p, starts, limit, want = at & 7, [], min(stop, cut), -(-(n - got) // 8)
        push = starts.append
        while p < limit and want:
            push(p)
            p += eight[p]
            want -= 1
        if not starts:
            raise Damaged("the stream is cut off")
        where = np.empty((len(starts), 8), np.int32)
        where[:, 0] = starts
        for k in range(1, 8):
            where[:, k] = where[:, k - 1] + one[where[:, k - 1]]
        flat = where.reshape(-1)[: n - got]
        out[got : got + len(flat)] = code.symbol[index[flat]]
        got += len(flat)
        at = 8 * first + int(flat[-1]) + int(one[flat[-1]])
        if at > bits.end:
            raise Damaged("the stream is cut off")
    bits.at = at
    return out


def _pixels(bits: Bits, width: int, height: int, spatial: bool) -> np.ndarray:
    """ARGB values, row after row. spatial: the image itself, which may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("the colour cache is too large")
    groups, block, of = 1, 0, None
    if spatial and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        of = (_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(of.max()) + 1
    sizes = (256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_prefix(bits, s) for s in sizes] for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not cache_bits and all(c.only is not None for c in (red, blue, alpha)) and green.most < 256:
        g = _lone_channel(bits, green, n).astype(np.uint32)
        return g << np.uint32(8) | np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    out, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    kept = 0  # pixels that the cache has seen
    while at < n:
        if of is None:
            g, r, b, a, d = codes[0]
        else:
            x, y = at % width, at // width
            g, r, b, a, d = codes[int(of[(y >> block) * across + (x >> block)])]
        s = g.next(bits)
        if s < 256:
            red = r.next(bits)
            blue = b.next(bits)
            out[at] = a.next(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTHS:
            length = _value(s - 256, bits)
            far = _value(d.next(bits), bits)
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + length > n:
                raise Damaged("a reference outside the image")
            if far >= length:
                out[at : at + length] = out[at - far : at - far + length]
            else:  # it repeats what it writes itself
                out[at : at + length] = (out[at - far : at] * (length // far + 1))[:length]
            at += length
        else:
            while kept < at:
                cache[(CACHE_FACTOR * out[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[kept]
                kept += 1
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
        if bits.at > bits.end:
            raise Damaged("the stream is cut off")
    return np.array(out, np.uint32)


# --- transforms; images are uint8 arrays of rows, columns and the channels A, R, G, B


def split(argb: np.ndarray, width: int) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(-1, width, 4)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _select(left, top, corner):
    # the sum of left + top - corner is nearer to left or to top
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left, top, right, corner):
    """The prediction from the neighbours to the left, above, above right and above left."""
    if mode == 0 or mode > 13:
        return (255, 0, 0, 0)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return [_clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    middle = _average(left, top)
    return [_clip(m + int((m - c) / 2)) for m, c in zip(middle, corner, strict=True)]


def unpredict(image: np.ndarray, modes: np.ndarray, block: int, back: bool = True) -> np.ndarray:
    """Adds predictions to residuals, or with back=False takes them from pixels. modes: a row of the blocks' modes each.
    The first row and column have modes of their own. Where all blocks look to the left, or all look up, sums along the
    rows or columns give all pixels at once."""
    height, width = image.shape[:2]
    if back and len(kinds := np.unique(modes)) == 1 and kinds[0] in (LEFT, TOP):
        out = image.copy()
        out[0, 0] += np.array([255, 0, 0, 0], np.uint8)
        if kinds[0] == LEFT:
            out[:, 0] = np.cumsum(out[:, 0], 0, dtype=np.uint8)
            return np.cumsum(out, 1, dtype=np.uint8)
        out[0] = np.cumsum(out[0], 0, dtype=np.uint8)
        return np.cumsum(out, 0, dtype=np.uint8)
    done = image.astype(int).tolist()
    src = [[list(p) for p in row] for row in done] if back else done
    out = [[[0] * 4 for _ in range(width)] for _ in range(height)]
    known = out if back else done
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = (255, 0, 0, 0) if x == 0 else known[0][x - 1]
            elif x == 0:
                p = known[y - 1][0]
            else:
                above = known[y - 1]
                right = above[x + 1] if x + 1 < width else known[y][0]
                p = predicted(int(modes[y >> block, x >> block]), known[y][x - 1], above[x], right, above[x - 1])
            sign = 1 if back else -1
            out[y][x] = [(s + sign * q) & 255 for s, q in zip(src[y][x], p, strict=True)]
    return np.array(out, np.uint8)


def uncross(image: np.ndarray, factors: np.ndarray, block: int, back: bool = True) -> np.ndarray:
    """Adds to red and blue what green, and to blue what red, foretell. factors: R, G, B of each block are red to blue,
    green to blue, green to red, as signed bytes in 1/32."""
    height, width = image.shape[:2]
    f = factors.view(np.int8).astype(int)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    red_blue, green_blue, green_red = f[..., 1], f[..., 2], f[..., 3]
    signed = lambda c: c.view(np.int8).astype(int)
    out, sign = image.copy(), 1 if back else -1
    green = signed(np.ascontiguousarray(image[..., 2]))
    red = (image[..., 1] + sign * ((green_red * green) >> 5)).astype(np.uint8)
    true_red = signed(red if back else np.ascontiguousarray(image[..., 1]))
    out[..., 1] = red
    out[..., 3] = (image[..., 3] + sign * (((green_blue * green) >> 5) + ((red_blue * true_red) >> 5))).astype(np.uint8)
    return out


def ungreen(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] += image[..., 2]
    out[..., 3] += image[..., 2]
    return out


def unpalette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours for indices, of which a green sample holds 8, 4 or 2 where the table is small; an index outside the table
    is transparent black."""
    n = len(table)
    packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = image[..., 2]
    if packed:
        step = 8 >> packed
        index = (index[..., None] >> (step * np.arange(1 << packed)).astype(np.uint8)) & np.uint8((1 << step) - 1)
        index = index.reshape(len(image), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[:n] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Rows, columns and the channels A, R, G, B of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            if len(body) < size:
                raise Damaged("the file is cut off")
            break
        at += 8 + size + (size & 1)
    if body is None:
        raise Damaged("no lossless image")
    bits = Bits(body)
    if bits.read(8) != SIGNATURE:
        raise Damaged("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # a hint that alpha is used
    if bits.read(3):
        raise Damaged("an unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Damaged("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICT, CROSS):
            block = bits.read(3) + 2
            cols = (wide + (1 << block) - 1) >> block
            extra = split(_pixels(bits, cols, (height + (1 << block) - 1) >> block, False), cols)
            undo.append((lambda im, e=extra, b=block: unpredict(im, e[..., 2] & 15, b)) if kind == PREDICT else (lambda im, e=extra, b=block: uncross(im, e, b)))
        elif kind == GREEN:
            undo.append(ungreen)
        else:
            n = bits.read(8) + 1
            table = np.cumsum(split(_pixels(bits, n, 1, False), n)[0], axis=0, dtype=np.uint8)
            undo.append(lambda im, t=table, w=wide: unpalette(im, t, w))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            wide = (wide + (1 << packed) - 1) >> packed
    image = split(_pixels(bits, wide, height, True), wide)
    for f in reversed(undo):
        image = f(image)
    return image


# --- encoder


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code, of at most LONGEST bits; rare symbols count as more common until that holds."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        up, k = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            n, a = heapq.heappop(heap)
            m, b = heap[0]
            up[a] = up[b] = k
            heapq.heapreplace(heap, (n + m, k))
            k += 1
        deep = [0] * k
        for i in range(k - 2, -1, -1):
            deep[i] = deep[up[i]] + 1
        if max(deep) <= LONGEST:
            lengths[used] = deep[: len(used)]
            return lengths
        least *= 2


class Writer:
    """Bits, lowest first, gathered as (value, length) pairs."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def put_prefix(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code: a simple one where one or two symbols under 256 have it, else its lengths, with runs of zeros."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(used[0] > 1, 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    runs, at, size = [], 0, len(lengths)
    values = lengths.tolist()
    while at < size:
        if values[at]:
            runs.append((values[at], 0, 0))
            at += 1
            continue
        to = at
        while to < size and not values[to] and to - at < 138:
            to += 1
        n = to - at
        runs += [(18, n - 11, 7)] if n >= 11 else [(17, n - 3, 3)] if n >= 3 else [(0, 0, 0)] * n
        at = to
    counts = np.bincount([r[0] for r in runs], minlength=19)
    own = code_lengths(counts)
    while own.max() > 7:  # these lengths have three bits
        counts = np.where(counts > 0, (counts + 1) // 2, 0) + (counts > 0)
        own = code_lengths(counts)
    w.put(0, 1)
    order = [int(own[k]) for k in LENGTH_ORDER]
    n = max(4, max(i for i, x in enumerate(order) if x) + 1)
    w.put(n - 4, 4)
    for x in order[:n]:
        w.put(x, 3)
    w.put(0, 1)  # all symbols' lengths follow
    codes, lone = canonical(own), (own > 0).sum() == 1
    for s, extra, bits in runs:
        w.put(int(codes[s]), 0 if lone else int(own[s]))
        w.put(extra, bits)


@cache
def _lone(symbols: tuple[int, ...]) -> tuple[int, int]:
    w = Writer()
    for only in symbols:
        one = np.zeros(256, np.int64)
        one[only] = 1
        put_prefix(w, one)
    return w.value, w.n


def put_lone(w: Writer, *symbols: int) -> None:
    """Prefix codes of one symbol each, which take no bits later."""
    w.put(*_lone(symbols))


@cache
def _fast():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


def put_flat(w: Writer, green: int) -> None:
    """An image of one colour inside the stream: no cache, and five codes of one symbol."""
    w.put(0, 1)
    put_lone(w, green, 0, 0, 255, 0)


def put_palette(w: Writer, greys: np.ndarray) -> None:
    """A palette of greys: each entry less the one before it."""
    w.put(1 | PALETTE << 1, 3)
    w.put(len(greys) - 1, 8)
    w.put(0, 1)
    step = np.diff(greys.astype(np.int64), prepend=0) & 255
    code = code_lengths(np.bincount(step, minlength=256 + LENGTHS))
    alpha = np.zeros(256, np.int64)
    alpha[[0, 255] if len(greys) > 1 else [255]] = 1
    for lengths in (code, code[:256], code[:256], alpha):
        put_prefix(w, lengths)
    put_lone(w, 0)
    bits, lone = canonical(code), (code > 0).sum() == 1
    for k, g in enumerate(step.tolist()):
        for _ in range(3):  # green, red, blue
            w.put(int(bits[g]), 0 if lone else int(code[g]))
        if len(greys) > 1:
            w.put(int(k == 0), 1)


def joined(w: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """What w holds and then values of so many bits each, lowest bit first."""
    parts, rest = [], (w.value, w.n)
    for at in range(0, len(values), 1 << 16):
        n = sizes[at : at + (1 << 16)]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.arange(int(ends[-1]), dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n)
        own = (np.repeat(values[at : at + (1 << 16)], n) >> place.astype(values.dtype)) & values.dtype.type(1)
        value, k = rest
        head = np.unpackbits(np.frombuffer(value.to_bytes(-(-k // 8) or 1, "little"), np.uint8), bitorder="little")[:k]
        bits = np.concatenate([head, own.astype(np.uint8)])
        whole = len(bits) // 8 * 8
        parts.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        left = bits[whole:]
        rest = (int(np.packbits(left, bitorder="little")[0]) if len(left) else 0, len(left))
    parts.append(rest[0].to_bytes(-(-rest[1] // 8), "little"))
    return b"".join(parts)


def symbol_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def references(data: bytes) -> list[tuple[int, int]]:
    """(length, distance) of back references and (0, byte) of literals that make up the data: at each place the longest
    of the repeats of what the latest place with the same KEY bytes began."""
    out, at, seen, n = [], 0, {}, len(data)
    while at < n:
        key = data[at : at + KEY]
        found, seen[key] = seen.get(key), at
        length = 0
        if found is not None and len(key) == KEY:
            length, most, step = KEY, min(4096, n - at), 64
            while length < most and data[at + length : at + length + step] == data[found + length : found + length + step]:
                length += step
            length = min(length, most)
            while length < most and data[at + length] == data[found + length]:
                length += 1
            out.append((length, at - found))
        else:
            out.append((0, data[at]))
        at += length or 1
    return out


def encode_repeats(w: Writer, data: bytes, most: int) -> bytes | None:
    """The pixels as literals and back references, or None where there are more than `most` of these."""
    ops = references(data)
    if len(ops) > most:
        return None
    green, far = [], []
    for length, x in ops:
        green.append(symbol_of(length) if length else (x, 0, 0))
        far.append(symbol_of(x + len(NEAR)) if length else (0, 0, 0))
    copies = np.array([length > 0 for length, _ in ops])
    g, d = np.array(green, np.int64), np.array(far, np.int64)
    g[copies, 0] += 256
    own = code_lengths(np.bincount(g[:, 0], minlength=256 + LENGTHS))
    away = code_lengths(np.bincount(d[copies, 0], minlength=DISTANCES)) if copies.any() else np.eye(1, DISTANCES, dtype=np.int64)[0]
    put_prefix(w, own)
    put_lone(w, 0, 0, 255)
    put_prefix(w, away)
    put = lambda lengths, k: (canonical(lengths)[k], np.where((lengths > 0).sum() == 1, 0, lengths[k]))
    (gc, gn), (dc, dn) = put(own, g[:, 0]), put(away, d[:, 0])
    # a literal is one code; a copy is its length's code and extra bits, then its distance's
    values = np.stack([gc, g[:, 1], np.where(copies, dc, 0), d[:, 1]], 1).reshape(-1).astype(np.uint32)
    sizes = np.stack([gn, g[:, 2], np.where(copies, dn, 0), d[:, 2]], 1).reshape(-1).astype(np.uint8)
    return joined(w, values, sizes)


def entropy(samples: np.ndarray) -> float:
    p = np.bincount(samples.reshape(-1), minlength=256)
    p = p[p > 0] / samples.size
    return float(-(p * np.log2(p)).sum())


KEY = 8  # bytes that a back reference repeats at least
REPEATS = 6  # how many times smaller a text must get by its repeats to be written by back references


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of grey samples, row after row, by what suits them:

    - a palette, several samples to a pixel, where there are few different ones;
    - literals and back references, where a fast compressor tells that the samples repeat themselves very much;
    - differences to the left or to the row above, where those have a clearly lower entropy than the samples;
    - otherwise the samples with a prefix code made for them.

    In all but the first red and blue are green, by the transform that takes green from both, so their codes take no bits."""
    height = len(samples) // width
    if width * height != len(samples) or not 0 < width <= MOST_SIDE or not 0 < height <= MOST_SIDE:
        raise ValueError("samples don't fill an image")
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    image, alpha, body = samples.reshape(height, width), 255, None
    greys = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(greys) <= 16:
        put_palette(w, greys)
        packed = 3 if len(greys) <= 2 else 2 if len(greys) <= 4 else 1
        index = np.zeros((height, -(-width // (1 << packed)) << packed), np.uint8)
        index[:, :width] = np.searchsorted(greys, image)
        steps = (np.arange(1 << packed) * (8 >> packed)).astype(np.uint8)
        image = np.bitwise_or.reduce(index.reshape(height, -1, 1 << packed) << steps, 2)
    else:
        data = samples.tobytes()
        if len(_fast().compress(data)) * REPEATS < len(data):
            lead = w.value, w.n
            w.put(1 | GREEN << 1, 3)
            w.put(0, 3)
            body = encode_repeats(w, data, len(data) // REPEATS)
            if body is None:
                w.value, w.n = lead
        if body is None:
            flat = image.copy()
            flat[1:, 0] -= image[:-1, 0]
            side, up = flat.copy(), flat.copy()
            side[:, 1:] -= image[:, :-1]
            up[1:, 1:] -= image[:-1, 1:]
            side[0, 0], up[0, 1:] = image[0, 0], side[0, 1:]
            least, mode, best = min((entropy(image), 0, 0), (entropy(side) + 0.05, 1, LEFT), (entropy(up) + 0.05, 2, TOP))
            if mode:
                w.put(1 | PREDICT << 1, 3)
                w.put(7, 3)  # blocks of 512
                put_flat(w, best)
                image, alpha = (side, up)[mode - 1], 0
            w.put(1 | GREEN << 1, 3)
    if body is None:
        w.put(0, 3)  # no more transforms, no colour cache, one group of codes
        flat = image.reshape(-1)
        lengths = code_lengths(np.bincount(flat, minlength=256 + LENGTHS))
        put_prefix(w, lengths)
        put_lone(w, 0, 0, alpha, 0)
        if (lengths > 0).sum() == 1:
            body = w.value.to_bytes(-(-w.n // 8), "little")
        else:
            body = joined(w, canonical(lengths).astype(np.uint16)[flat], lengths.astype(np.uint8)[flat])
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
