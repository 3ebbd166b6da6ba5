import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import media, webp


class Code:
    """A prefix code made of counts, for streams that a test writes by hand."""

    def __init__(self, symbols, size):
        self.lengths = webp.code_lengths(np.bincount(symbols or [0], minlength=size))
        self.codes, self.lone = webp.canonical(self.lengths), (self.lengths > 0).sum() == 1

    def put(self, w, s):
        w.put(int(self.codes[s]), 0 if self.lone else int(self.lengths[s]))


def prefix_of(value):
    """Symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def tokens_of(argb, width, cache_bits, rng, refs):
    """Literals, cache hits and back references that make up the pixels."""
    out, at, cache = [], 0, {}
    slot = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(argb):
        best = None
        if refs and at:
            for far in {1, 2, 3, width, width + 1, rng.randint(1, at)}:
                n = 0
                while far <= at and at + n < len(argb) and argb[at + n] == argb[at + n - far] and n < 4096:
                    n += 1
                if n >= 2 and (not best or n > best[1]):
                    best = (far, n)
        if best:
            far, n = best
            near = [k + 1 for k, (dx, dy) in enumerate(webp.NEAR) if max(1, dx + dy * width) == far]
            out.append(("copy", n, rng.choice(near) if near and rng.random() < 0.7 else far + 120))
            step = n
        elif cache_bits and cache.get(slot(argb[at])) == argb[at]:
            out.append(("cache", slot(argb[at])))
            step = 1
        else:
            out.append(("pixel", argb[at]))
            step = 1
        if cache_bits:
            for p in argb[at : at + step]:
                cache[slot(p)] = p
        at += step
    return out


def put_image(w, argb, width, rng, spatial, cache_bits=0, refs=False, groups=None):
    argb = [int(x) for x in argb]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    pick = lambda at: 0
    many = 1
    if spatial:
        w.put(1 if groups else 0, 1)
        if groups:
            block, of, many = groups
            w.put(block - 2, 3)
            across = -(-width // (1 << block))
            put_image(w, [int(g) << 8 for g in of], across, rng, False)
            pick = lambda at: of[(at // width >> block) * across + (at % width >> block)]
    toks, at, seen = tokens_of(argb, width, cache_bits, rng, refs), 0, [[[] for _ in range(5)] for _ in range(many)]
    placed = []
    for t in toks:
        g = pick(at)
        placed.append((g, t))
        s = seen[g]
        if t[0] == "pixel":
            p = t[1]
            for k, v in zip((0, 1, 2, 3), (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=True):
                s[k].append(v)
            at += 1
        elif t[0] == "cache":
            s[0].append(280 + t[1])
            at += 1
        else:
            s[0].append(256 + prefix_of(t[1])[0])
            s[4].append(prefix_of(t[2])[0])
            at += t[1]
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[Code(x, n) for x, n in zip(s, sizes, strict=True)] for s in seen]
    for group in codes:
        for c in group:
            webp.put_prefix(w, c.lengths)
    for g, t in placed:
        c = codes[g]
        if t[0] == "pixel":
            p = t[1]
            for k, v in zip((0, 1, 2, 3), (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=True):
                c[k].put(w, v)
        elif t[0] == "cache":
            c[0].put(w, 280 + t[1])
        else:
            for k, v in ((0, t[1]), (4, t[2])):
                sym, extra, n = prefix_of(v)
                c[k].put(w, sym + (256 if k == 0 else 0))
                w.put(extra, n)


def argb_of(image):
    return np.ascontiguousarray(image).view(">u4").reshape(-1).astype(np.uint32)


def file_of(w):
    import struct

    body = w.value.to_bytes(-(-w.n // 8), "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def start(width, height):
    w = webp.Writer()
    for v, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def picture(width, height, rng, colours=None):
    if colours:
        table = rng.integers(0, 256, (colours, 4), np.uint8)
        return table[rng.integers(0, colours, (height, width))]
    y, x = np.mgrid[:height, :width]
    return np.stack([x * 0 + 255, x * 3 + rng.integers(0, 4, x.shape), y * 2 + x, x + y], -1).astype(np.uint8)


@pytest.mark.parametrize("cache_bits,refs,grouped", [(0, False, False), (5, False, False), (0, True, False), (4, True, True), (11, True, False)])
def test_entropy_coding(cache_bits, refs, grouped):
    rng, r = np.random.default_rng(cache_bits), random.Random(3)
    image = picture(37, 21, rng, 9)
    image[5:9] = image[4]
    w = start(37, 21)
    w.put(0, 1)
    groups = (3, [r.randrange(3) for _ in range(5 * 3)], 3) if grouped else None
    if groups:
        groups[1][0] = 2
    put_image(w, argb_of(image), 37, r, True, cache_bits, refs, groups)
    assert (webp.decode(file_of(w)) == image).all()


def test_all_predictors_and_cross_colour():
    rng, r = np.random.default_rng(8), random.Random(8)
    width, height, block = 45, 33, 2
    image = picture(width, height, rng)
    cols, rws = 12, 9
    modes = np.arange(cols * rws).reshape(rws, cols) % 14
    cross = rng.integers(0, 256, (rws, cols, 4), np.uint8)
    cross[..., 0] = 255
    w = start(width, height)
    w.put(1 | webp.PREDICT << 1, 3)
    w.put(block - 2, 3)
    put_image(w, (modes << 8).reshape(-1), cols, r, False)
    w.put(1 | webp.CROSS << 1, 3)
    w.put(block - 2, 3)
    put_image(w, argb_of(cross), cols, r, False)
    w.put(1 | webp.GREEN << 1, 3)
    w.put(0, 1)
    coded = webp.unpredict(image, modes, block, back=False)
    coded = webp.uncross(coded, cross, block, back=False)
    coded[..., 1] -= coded[..., 2]
    coded[..., 3] -= coded[..., 2]
    put_image(w, argb_of(coded), width, r, True, 3, True)
    assert (webp.decode(file_of(w)) == image).all()


def test_predictions_by_hand():
    left, top, right, corner = (10, 20, 30, 40), (12, 26, 30, 50), (20, 20, 20, 20), (8, 30, 30, 44)
    p = lambda m: tuple(webp.predicted(m, left, top, right, corner))
    assert p(0) == (255, 0, 0, 0) and [p(m) for m in (1, 2, 3, 4)] == [left, top, right, corner]
    assert p(5) == (13, 23, 27, 40) and p(6) == (9, 25, 30, 42) and p(7) == (11, 23, 30, 45) and p(9) == (16, 23, 25, 35)
    assert p(12) == (14, 16, 30, 46) and p(13) == (12, 20, 30, 45)
    # the gradient left + top - corner is (14, 16, 30, 46): 14 away from left, 16 from top in sum
    assert p(11) == left


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 40, 256])
def test_palettes(colours):
    rng, r = np.random.default_rng(colours), random.Random(1)
    width, height = 29, 7
    table = np.unique(rng.integers(0, 256, (colours * 3, 4), np.uint8), axis=0)[:colours]
    index = rng.integers(0, len(table), (height, width))
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    wide = -(-width // (1 << packed))
    green = np.zeros((height, wide), int)
    for x in range(width):
        green[:, x >> packed] |= index[:, x] << ((8 >> packed) * (x & ((1 << packed) - 1)))
    w = start(width, height)
    w.put(1 | webp.PALETTE << 1, 3)
    w.put(len(table) - 1, 8)
    put_image(w, argb_of(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), r, False)
    w.put(0, 1)
    put_image(w, (green << 8).reshape(-1), wide, r, True)
    assert (webp.decode(file_of(w)) == table[index]).all()


def test_damage_is_told():
    data = webp.encode_grey(np.frombuffer(media.padded(b"some text " * 40), np.uint8), 192)
    for bad in (b"", data[:20], data[:-9], b"JUNK" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(webp.Damaged):
            webp.decode(bad)


TEXTS = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "the quick brown fox " * 400, "".join(chr(i) for i in range(1, 2000) if chr(i).isprintable()), "long " * 300_000, "b\0c"]


def test_round_trip_through_the_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "a", "a"])], "doc_id long, text string")
    got = {r.doc_id: r for r in media.digest(df).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        full = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert tuple(got[2])[1:] == tuple(got[10])[1:] == tuple(got[11])[1:]
    assert media.digest(df.limit(0)).count() == 0


def test_media_and_pixel_columns(spark):
    df = spark.createDataFrame([(1, "ab", b"old")], "doc_id long, text string, media binary")
    rows = media.read_media(media.to_media(df)).collect()
    assert rows[0].pixels == b"ab" + b" " * 190 and (rows[0].width, rows[0].height, rows[0].n_bytes) == (192, 1, 2)
    nothing = media.read_media(spark.createDataFrame([(None,)], "media binary")).first()
    assert nothing.pixels is None and nothing.width is None


def test_every_length_fits(spark):
    rows = 16411  # a prime number, too many rows for an image 192 wide
    text = "plain " * (rows * 32 - 1) + "ending"
    df = spark.createDataFrame([(1, text), (2, text[:-1]), (3, text + "z"), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in media.digest(df).collect()}
    for i, t in ((1, text), (2, text[:-1]), (3, text + "z"), (4, "short")):
        full = media.padded(t.encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(t), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert got[1].payload_bytes == rows * 192 and got[1].feature.startswith("384x8206;")
    read = media.read_media(media.to_media(df.where("doc_id = 1"))).first()
    assert read.pixels[: read.n_bytes] == text.encode() and len(read.pixels) == read.width * read.height


def test_widths():
    for rows in (*range(1, 90_000, 7), 16384, 16385, 16411, 85 * 16384, 85 * 16384 + 1, (1 << 28) // 192):
        width = media.width_of(rows * 192)
        assert width <= 16384 and -(-rows * 192 // width) <= 16384
        assert rows > 16384 or width == 192
    with pytest.raises(ValueError):
        media.width_of(((1 << 28) // 192 + 1) * 192)


def test_encoder_takes_what_suits_the_samples(monkeypatch):
    rng = np.random.default_rng(3)
    used = []
    for name in ("put_palette", "put_flat", "encode_repeats"):
        old = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, f=old, n=name: (used.append(n), f(*a))[1])
    cases = [
        (b"x" * 4800, ["put_palette"]),
        (bytes(rng.choice(list(b"ab"), 2880).astype(np.uint8)), ["put_palette"]),
        (bytes(rng.choice(list(b"abcd"), 2880).astype(np.uint8)), ["put_palette"]),
        (bytes(rng.choice(list(b"0123456789ABCDEF"), 2880).astype(np.uint8)), ["put_palette"]),
        (b"the quick brown fox jumps over the lazy dog. " * 3000, ["encode_repeats"]),
        (bytes(range(17)) * 100, ["encode_repeats"]),
        (np.cumsum(rng.integers(0, 3, 30_000)).astype(np.uint8).tobytes(), ["put_flat"]),
        ((np.tile(rng.integers(0, 256, 192), (100, 1)) + rng.integers(0, 2, (100, 192)).cumsum(0)).astype(np.uint8).tobytes(), ["put_flat"]),
        (rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), []),
        ("eine Zeile mit Wörtern und Zahlen 12345, dann noch eine. ".encode() + bytes(rng.integers(32, 127, 900).astype(np.uint8)), []),
    ]
    for data, want in cases:
        used.clear()
        data = media.padded(data)
        width = media.width_of(len(data))
        file = webp.encode_grey(np.frombuffer(media.filled(data, width), np.uint8), width)
        assert used == want, data[:20]
        image = webp.decode(file)
        assert image[..., 2].tobytes()[: len(data)] == data
        assert (image[..., 0] == 255).all() and (image[..., 1] == image[..., 2]).all() and (image[..., 3] == image[..., 2]).all()


def test_encoder_round_trips_of_random_samples():
    r = random.Random(6)
    for _ in range(250):
        some = r.choice([2, 3, 5, 16, 17, 60, 256])
        data = bytes(r.randrange(some) for _ in range(r.randint(0, 2000))) * r.choice([1, 1, 3, 20])
        data = media.padded(data)
        width = media.width_of(len(data))
        assert webp.decode(webp.encode_grey(np.frombuffer(data, np.uint8), width))[..., 2].tobytes() == data


def test_fast_predictions_equal_the_slow_ones():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 7), (7, 1), (9, 13)):
        image = rng.integers(0, 256, (*shape, 4)).astype(np.uint8)
        for mode in (webp.LEFT, webp.TOP):
            modes = np.full((-(-shape[0] // 4), -(-shape[1] // 4)), mode, np.uint8)
            rest = webp.unpredict(image, modes, 2, back=False)
            assert (webp.unpredict(rest, modes, 2) == image).all()
            mixed = np.pad(modes, ((0, 1), (0, 0)), constant_values=0)  # a mode that no pixel has: the slow way
            assert (webp.unpredict(rest, mixed, 2) == image).all()


def test_references_spell_the_data():
    r = random.Random(8)
    for _ in range(60):
        data = (bytes(r.randrange(4) for _ in range(r.randint(0, 60))) * r.randint(1, 200))[:9000]
        out = bytearray()
        for length, x in webp.references(data):
            if length:
                assert 8 <= length <= 4096 and 0 < x <= len(out)
                for _ in range(length):
                    out.append(out[-x])
            else:
                out.append(x)
        assert bytes(out) == data


def test_feature_equals_plain_loops():
    import math
    from collections import Counter

    r = random.Random(5)
    for _ in range(30):
        rows, cols = r.randint(1, 6), r.randint(1, 9)
        image = np.array([[r.randrange(r.choice((2, 256))) for _ in range(cols)] for _ in range(rows)], np.uint8)
        flat = [int(x) for x in image.reshape(-1)]
        mean = sum(flat) / len(flat)
        spread = math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat))
        bits = -sum(n / len(flat) * math.log2(n / len(flat)) for n in Counter(flat).values())
        steps = [abs(int(a) - int(b)) for row in image for a, b in zip(row, row[1:], strict=False)]
        size, *numbers = media.feature(image).split(";")
        assert size == f"{cols}x{rows}"
        for got, want in zip(numbers, (mean, spread, bits, sum(steps) / len(steps) if steps else 0.0), strict=True):
            assert abs(float(got) - want) <= 5.1e-5
