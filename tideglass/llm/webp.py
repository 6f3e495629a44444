"""Lossless WebP images as media columns: a full decoder, and an encoder for byte payloads."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: order of the code length codes, alphabet sizes of the prefix codes (green
# without colour cache, red, blue, alpha, distance), and the plane offsets of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
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
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHA, RED, GREEN, BLUE = 3, 2, 1, 0  # places in a little-endian pixel
#: Samples in a row of a payload's image, and rows of one image at most; longer payloads are several images.
ROW, ROWS = 64, 16384
#: Fixed values of the format: longest copy, longest distance, longest code, most bits a pixel can take.
COPY, FAR, LONGEST, PIXEL_BITS = 4096, (1 << 20) - 120, 15, 128
#: Shortest copy that is written.
SHORT = 7
#: Bits of the stream that are looked up at once.
STRETCH = 1 << 16


class Bits:
    """Bits of a stream, the lowest of each byte first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.held, self.base, self.end = 0, 0, -1

    def peek(self, n: int) -> int:
        """The next ``n`` bits, 32 at most; past the end are zeros."""
        if not self.base <= self.at <= self.end:
            self.base = self.at & ~7
            self.end, self.held = self.base + 1024, self.number(1024 + 32)
        return self.held >> (self.at - self.base) & ((1 << n) - 1)

    def number(self, n: int) -> int:
        """At least the next ``n`` bits from the start of this byte on, as one number; past the end are zeros."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + n // 8 + 2], "little")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")

    def windows(self, most: int) -> np.ndarray:
        """The 32 bits from each place on, for up to ``most`` places from here; past the end are zeros."""
        first, shift = divmod(self.at, 8)
        n = (most + shift + 7) // 8
        part = self.data[first : first + n + 4]
        raw = np.frombuffer(part + b"\0" * (n + 4 - len(part)), dtype=np.uint8).astype(np.uint64)
        wide = raw[:n] | raw[1 : n + 1] << np.uint64(8) | raw[2 : n + 2] << np.uint64(16) | raw[3 : n + 3] << np.uint64(24) | raw[4 : n + 4] << np.uint64(32)
        return (wide[:, None] >> np.arange(8, dtype=np.uint64)).reshape(-1)[shift : shift + most].astype(np.uint32)


@functools.cache
def _reversed(depth: int) -> np.ndarray:
    """Each number of ``depth`` bits with its bits turned round."""
    n = np.arange(1 << depth, dtype=np.int64)
    return sum((n >> k & 1) << (depth - 1 - k) for k in range(depth)) + np.zeros(1 << depth, dtype=np.int64)


class Code:
    """A canonical prefix code as a table: for each value of the next ``depth`` bits the symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self._single(int(used[0]) if len(used) else 0)
            return
        size = lengths[used]
        if int((1 << (LONGEST - size)).sum()) != 1 << LONGEST:
            raise ValueError("a prefix code is not complete")
        order = np.argsort(size, kind="stable")
        self.only, self.depth, self.table = None, int(size.max()), None
        at = np.repeat(order, 1 << (self.depth - size[order]))[_reversed(self.depth)]
        self.symbol, self.length = used[at], size[at]

    def _single(self, symbol: int) -> None:
        self.depth, self.only = 0, symbol
        self.symbol, self.length = np.array([symbol]), np.zeros(1, dtype=np.int64)

    @classmethod
    def single(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code._single(symbol)
        return code

    def read(self, bits: Bits) -> int:
        if not self.depth:
            return self.only
        if self.table is None:
            self.table = (self.symbol << 4 | self.length).tolist()
        step = self.table[bits.peek(self.depth)]
        bits.skip(step & 15)
        return step >> 4


@functools.cache
def _places(depth: int) -> list[int]:
    return _reversed(depth).tolist()


def _kinds_table(kinds: list[int]) -> list[int]:
    """The code of code lengths (at most 7 bits each): symbol and length for each value of the next bits."""
    used = sorted((n, k) for k, n in enumerate(kinds) if n)
    if len(used) < 2:
        return [used[0][1] << 4 if used else 0]
    depth = used[-1][0]
    flat = [k << 4 | n for n, k in used for _ in range(1 << (depth - n))]
    if len(flat) != 1 << depth:
        raise ValueError("a prefix code is not complete")
    return [flat[k] for k in _places(depth)]


def _code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return Code.single(first)
        lengths = np.zeros(alphabet, dtype=np.int64)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    lengths: list[int] = []
    kinds = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        kinds[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, last = _kinds_table(kinds), 8
    mask = len(table) - 1
    at = start = bits.at & 7
    ahead = bits.number(14 * alphabet)  # of at most 7 bits and 7 more for a length
    while len(lengths) < alphabet and left:
        left -= 1
        step = table[ahead >> at & mask]
        at += step & 15
        k = step >> 4
        if k < 16:
            lengths.append(k)
            last = k or last
        elif k == 16:
            lengths += [last] * (3 + (ahead >> at & 3))
            at += 2
        elif k == 17:
            lengths += [0] * (3 + (ahead >> at & 7))
            at += 3
        else:
            lengths += [0] * (11 + (ahead >> at & 127))
            at += 7
    bits.skip(at - start)
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return Code(np.array(lengths + [0] * (alphabet - len(lengths)), dtype=np.int64))


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


@functools.cache
def _distances(width: int) -> np.ndarray:
    """Distances of the codes up to 120 in images of that width; code 0 is none."""
    return np.array([1, *[max(1, x + y * width) for x, y in NEAR]])


@functools.cache
def _extras(alphabet: int) -> np.ndarray:
    """How many extra bits an amount's prefix symbol has; in the green alphabet literals have none."""
    prefix = np.arange(alphabet) - (256 if alphabet == ALPHABETS[0] else 0)
    return np.where(prefix < 4, 0, (prefix - 2) >> 1)


def _read_amounts(prefix: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Amounts of prefix symbols, the next bits after which are ``window``."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra) + (window & ((1 << extra) - 1)) + 1


def _grey(bits: Bits, green: Code, distance: Code, width: int, n: int) -> np.ndarray:
    """The green values of an image whose other channels are constant, without cache and groups.

    For each place of a stretch of the stream it is looked up at once which symbol would stand there and where the
    next one would; then the chain of those that do stand there is followed, and literals, lengths and
    distances are taken from it in bulk. Only copies are made one after another.
    """
    out, done = bytearray(n), 0
    step = green.length + _extras(ALPHABETS[0])[green.symbol]
    far_step = distance.length + _extras(ALPHABETS[4])[distance.symbol]
    mask, far_mask = np.uint32((1 << green.depth) - 1), np.uint32((1 << distance.depth) - 1)
    near = _distances(width)
    while done < n:
        end = 8 * len(bits.data) - bits.at
        stop = min(STRETCH, end)
        if stop <= 0:
            raise ValueError("the image ends early")
        window = bits.windows(stop + PIXEL_BITS)
        key = window[:stop] & mask
        symbol = green.symbol.take(key)
        following = step.take(key)
        following += np.arange(stop)
        some = (symbol > 255).nonzero()[0]
        following[some] += far_step.take(window.take(following[some]) & far_mask)
        one = np.append(np.minimum(following, stop), stop)
        two = one.take(one)
        chain, at, jump = [], 0, memoryview(two.take(two))  # every fourth of the chain, then those between
        while at < stop:
            chain.append(at)
            at = jump[at]
        place = np.array(chain)
        place = np.stack([place, one[place], two[place], one[two[place]]], axis=1).ravel()
        place = place[place < stop]
        symbol = symbol[place]
        copy = (symbol > 255).nonzero()[0]
        lengths = np.ones(len(place), dtype=np.int64)
        start = place[copy]
        size = symbol[copy] - 256
        after = start + green.length.take(window.take(start) & mask)
        lengths[copy] = _read_amounts(size, window.take(after).astype(np.int64))
        ends = np.cumsum(lengths) + done
        whole = min(int(np.searchsorted(ends, n)), len(ends) - 1)  # symbols from here on belong to what comes next
        if ends[whole] > n:
            raise ValueError("a copy leaves the image")
        copy = copy[copy <= whole]
        k = len(copy)
        after = after[:k] + _extras(ALPHABETS[0])[symbol[copy]]
        far_key = window.take(after) & far_mask
        far = _read_amounts(distance.symbol.take(far_key), window.take(after + distance.length.take(far_key)).astype(np.int64))
        far = np.where(far > 120, far - 120, near[np.minimum(far, 120)])
        first = ends - lengths
        if (far > first[copy]).any():
            raise ValueError("a copy leaves the image")
        symbol = symbol[: whole + 1]
        literal = symbol < 256
        np.frombuffer(out, dtype=np.uint8)[first[: whole + 1][literal]] = symbol[literal]
        for a, m, d in zip(first[copy].tolist(), lengths[copy].tolist(), far.tolist(), strict=True):
            out[a : a + m] = out[a - d : a - d + m] if d >= m else (out[a - d : a] * (m // d + 1))[:m]
        done = int(ends[whole])
        bits.skip(int(following[place[whole]]))
    return np.frombuffer(out, dtype=np.uint8).astype(np.uint32)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: pixels as unsigned 32-bit ARGB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1) if main else 0:
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        groups = (_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False) >> np.uint32(8)) & np.uint32(0xFFFF)
    else:
        shift, across, groups = 0, 0, np.zeros(1, dtype=np.uint32)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [[_code(bits, n) for n in sizes] for _ in range(int(groups.max()) + 1)]
    green, red, blue, alpha, distance = codes[0]
    if len(codes) == 1 and not cache_bits and not (red.depth or blue.depth or alpha.depth):
        rest = np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
        if not green.depth and green.only < 256:
            return np.full(width * height, rest | np.uint32(green.only << 8), dtype=np.uint32)
        return rest | _grey(bits, green, distance, width, width * height) << np.uint32(8)
    out = [0] * (width * height)
    cache, hold = [0] * (1 << cache_bits), (lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits))
    at = 0
    while at < len(out):
        group = codes[int(groups[(at // width >> shift) * across + (at % width >> shift)]) if across else 0]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            done = [a << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            n = _amount(bits, s - 256)
            d = _amount(bits, group[4].read(bits))
            d = d - 120 if d > 120 else int(_distances(width)[d])
            if d > at or at + n > len(out):
                raise ValueError("a copy leaves the image")
            done = [out[at - d + k % d] for k in range(n)]
        else:
            done = [cache[s - 280]]
        out[at : at + len(done)] = done
        at += len(done)
        if cache_bits:
            for p in done:
                cache[hold(p)] = p
    return np.array(out, dtype=np.uint32)


def _predicted(mode: int, left, top, right_top, left_top) -> list[int]:
    """A pixel's prediction from its neighbours, each a list of four bytes."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (1, 2, 3, 4):
        return (left, top, right_top, left_top)[mode - 1]
    if mode == 5:
        return half(half(left, right_top), top)
    if mode in (6, 7):
        return half(left, left_top if mode == 6 else top)
    if mode in (8, 9):
        return half(left_top if mode == 8 else right_top, top)
    if mode == 10:
        return half(half(left, left_top), half(top, right_top))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, left_top, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, left_top, strict=True))
        return left if to_left < to_top else top
    clamp = lambda x: min(255, max(0, x))
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, left_top, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), left_top, strict=True)]
    return [0, 0, 0, 255]


def predict_all(pixels: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """Add predictions to residuals (inverse), or take them from pixels."""
    data = pixels.view(np.uint8).reshape(height, width, 4)
    if not inverse:
        whole, out = data.astype(int), np.empty_like(data)
    else:
        out = data.copy()
        whole = out
    across = (width + (1 << shift) - 1) >> shift
    only = np.unique(modes >> np.uint32(8) & np.uint32(15)).tolist()
    if inverse and only in ([1], [2]):  # sums along rows, or down columns: no pixel by pixel
        sums = data.astype(np.uint64)
        sums[0, 0, ALPHA] += 255
        sums[0] = np.cumsum(sums[0], axis=0)
        if only == [1]:
            sums[:, 0] = np.cumsum(sums[:, 0], axis=0)
            sums[1:] = np.cumsum(sums[1:], axis=1)
        else:
            sums = np.cumsum(sums, axis=0)
        return sums.astype(np.uint8).reshape(-1, 4).view(np.uint32)[:, 0]
    for y in range(height):
        for x in range(width):
            if not y:
                guess = [0, 0, 0, 255] if not x else whole[0, x - 1].tolist()
            elif not x:
                guess = whole[y - 1, 0].tolist()
            else:
                mode = int(modes[(y >> shift) * across + (x >> shift)] >> 8) & 15
                corner = whole[y - 1, x + 1] if x + 1 < width else whole[y, 0]
                guess = _predicted(mode, whole[y, x - 1].tolist(), whole[y - 1, x].tolist(), corner.tolist(), whole[y - 1, x - 1].tolist())
            out[y, x] = [(int(v) + g if inverse else int(v) - g) & 255 for v, g in zip(data[y, x], guess, strict=True)]
    return out.reshape(-1, 4).copy().view(np.uint32)[:, 0]


def cross_all(pixels: np.ndarray, width: int, height: int, shift: int, factors: np.ndarray, inverse: bool) -> np.ndarray:
    """Put back (inverse) or take out what green says of red and blue, and red of blue."""
    across = (width + (1 << shift) - 1) >> shift
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[(y >> shift) * across + (x >> shift)].view(np.uint8).reshape(-1, 4).astype(np.int8).astype(int)
    out = pixels.view(np.uint8).reshape(-1, 4).copy()
    part = lambda t, c: (t * c.astype(np.int8).astype(int)) >> 5
    way = 1 if inverse else -1
    old_red = out[:, RED].copy()
    out[:, RED] = (out[:, RED] + way * part(f[:, 0], out[:, GREEN])) & 255
    red = out[:, RED] if inverse else old_red
    out[:, BLUE] = (out[:, BLUE] + way * (part(f[:, 1], out[:, GREEN]) + part(f[:, 2], red))) & 255
    return out.view(np.uint32)[:, 0]


def green_all(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    out = pixels.view(np.uint8).reshape(-1, 4).copy()
    way = out[:, GREEN] if inverse else -out[:, GREEN]
    out[:, RED] += way
    out[:, BLUE] += way
    return out.view(np.uint32)[:, 0]


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode_image(data: bytes) -> np.ndarray:
    """One lossless WebP file as an array of height x width x (blue, green, red, alpha)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) >> 1:
        raise ValueError("unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == SUBTRACT_GREEN:
            undo.append(lambda p, w: green_all(p, True))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _pixels(bits, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.zeros((256, 4), dtype=np.uint8)
            colours[:n] = np.cumsum(steps, axis=0, dtype=np.uint64).astype(np.uint8)
            shift, whole = _bundle(n), across
            across = (across + (1 << shift) - 1) >> shift

            def unpack(p, w, colours=colours.view(np.uint32)[:, 0], shift=shift, whole=whole):
                value = ((p >> np.uint32(8)) & np.uint32(255)).reshape(height, w)
                each = 8 >> shift
                number = (value[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)
                return colours[number.reshape(height, -1)[:, :whole].ravel()]

            undo.append(unpack)
        else:
            shift = bits.read(3) + 2
            size = ((across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift)
            blocks = _pixels(bits, *size, False)
            change = predict_all if kind == PREDICTOR else cross_all
            undo.append(lambda p, w, change=change, shift=shift, blocks=blocks: change(p, w, height, shift, blocks, True))
    pixels = _pixels(bits, across, height, True)
    for step in reversed(undo):
        pixels = step(pixels, across)
        across = len(pixels) // height
    return pixels.view(np.uint8).reshape(height, width, 4)


def images(data: bytes) -> Iterator[bytes]:
    """The files of a media column, which may hold several one after another."""
    at = 0
    while at < len(data):
        end = at + 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at:end]
        at = end


def riff(bits: np.ndarray) -> bytes:
    body = b"\x2f" + np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a prefix code for symbols by their counts, none over ``limit``; symbols that don't occur have none."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = counts.nonzero()[0]
    lengths[used] = _depths(counts[used].tolist(), limit)
    return lengths


def _depths(weights: list[int], limit: int) -> list[int]:
    """:func:`code_lengths` of symbols that all occur. Leaves by weight and nodes as they are made are two queues in order."""
    n = len(weights)
    if n < 2:
        return [1] * n
    while True:
        leaves = sorted(range(n), key=weights.__getitem__)
        light = [weights[k] for k in leaves]
        light.append(1 << 62)
        made: list[int] = []
        parent = [0] * (2 * n - 1)
        i = j = 0
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if j == len(made) or light[i] <= made[j]:
                    total += light[i]
                    parent[leaves[i]] = new
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = new
                    j += 1
            made.append(total)
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            return depth[:n]
        weights = [(w + 1) // 2 for w in weights]


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, its first bit lowest."""
    words = np.zeros(len(lengths), dtype=np.int64)
    used = lengths.nonzero()[0]
    order = used[lengths[used].argsort(kind="stable")]
    size = lengths[order]
    room = 1 << (LONGEST - size)
    first = np.cumsum(room) - room
    words[order] = _reversed(LONGEST)[first & ((1 << LONGEST) - 1)]
    return words


def amounts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of amounts from 1 on."""
    x = values - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.where(x < 4, 0, high - 1)
    prefix = np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1))
    return prefix, x & ((1 << extra) - 1), extra


@functools.cache
def _short_codes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances that have a short code in images of that width, and the codes."""
    found: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR):
        found.setdefault(max(1, x + y * width), k + 1)
    keys = np.array(sorted(found))
    return keys, np.array([found[k] for k in keys.tolist()])


def copies(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """``(place, length, distance)`` of what is copied from before, in order and without overlaps.

    Each run of SHORT samples looks for its last occurrence; places in a row that look equally far back are one copy.
    """
    n = len(samples) - SHORT + 1
    if n < 2:
        return []
    key = np.ndarray(n, dtype="<u8", buffer=samples.tobytes() + b"\0" * (8 - SHORT), strides=(1,)) & np.uint64((1 << 8 * SHORT) - 1)
    # short images are sorted by 16 bits of a hash, which is faster and misses hardly any
    order = np.argsort(key if n > 1 << 13 else (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    ordered = key.take(order)
    same = (ordered[1:] == ordered[:-1]).nonzero()[0]
    if not len(same):
        return []
    back = np.zeros(n, dtype=np.int64)
    later = order.take(same + 1)
    back[later] = later - order.take(same)
    starts = _run_starts(back)
    ends = np.append(starts[1:], n)
    kept = (back[starts] > 0) & (back[starts] <= FAR)
    out, at = [], 0
    for start, end, d in zip(starts[kept].tolist(), (ends[kept] + SHORT - 1).tolist(), back[starts[kept]].tolist(), strict=True):
        start = max(start, at)
        while end - start >= SHORT:
            length = min(COPY, end - start)
            out.append((start, length, d))
            at = start = start + length
    return out


def _run_starts(x: np.ndarray) -> np.ndarray:
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


class _Out:
    """Fields of a stream: values and how many bits each takes."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, dtype=np.int64), np.array(self.sizes, dtype=np.int64)), (values, sizes)]
        self.values, self.sizes = [], []

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code: one or two symbols by name, others by the lengths of all, whose runs are coded again."""
        used = np.flatnonzero(lengths).tolist() or [0]
        if len(used) < 3 and used[-1] < 256:
            self.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
            for symbol in used:
                self.put(symbol, 8)
            return
        starts = _run_starts(lengths)
        kind, value, bits = [], [], []
        for length, n in zip(lengths[starts].tolist(), (np.append(starts[1:], len(lengths)) - starts).tolist(), strict=True):
            if length:
                kind.append(length)
                value.append(0)
                bits.append(0)
                n -= 1
            while n >= 3:
                name, least, most, size = (16, 3, 6, 2) if length else (18, 11, 138, 7) if n > 10 else (17, 3, 10, 3)
                k = min(n, most)
                kind.append(name)
                value.append(k - least)
                bits.append(size)
                n -= k
            if n:
                kind += [length] * n
                value += [0] * n
                bits += [0] * n
        counts = [0] * 19
        for k in kind:
            counts[k] += 1
        some = [k for k in range(19) if counts[k]]
        kinds = dict(zip(some, _depths([counts[k] for k in some], 7), strict=True))
        last = max(k for k, name in enumerate(LENGTH_ORDER) if name in kinds or k == 3)
        self.put(0, 1)
        self.put(last - 3, 4)
        for name in LENGTH_ORDER[: last + 1]:
            self.put(kinds.get(name, 0), 3)
        self.put(0, 1)
        words, place = {}, 0
        for size, name in sorted((n, k) for k, n in kinds.items()):
            words[name] = (_places(7)[place], size if len(kinds) > 1 else 0)
            place += 1 << (7 - size)
        for k, extra, size in zip(kind, value, bits, strict=True):
            self.put(*words[k])
            if size:
                self.put(extra, size)

    def grey(self, samples: np.ndarray, width: int, rest: tuple[int, int, int], main: bool) -> None:
        """An image whose green channel is ``samples`` and whose red, blue and alpha are constant."""
        made = np.array(copies(samples), dtype=np.int64).reshape(-1, 3)
        covered = np.zeros(len(samples) + 1, dtype=np.int64)
        covered[made[:, 0]] += 1
        covered[made[:, 0] + made[:, 1]] -= 1  # copies don't overlap: no place is the end of two
        literal = (covered[:-1].cumsum() == 0).nonzero()[0]
        size, size_extra, size_bits = amounts(made[:, 1])
        keys, short = _short_codes(width)
        near = np.minimum(np.searchsorted(keys, made[:, 2]), len(keys) - 1)
        far, far_extra, far_bits = amounts(np.where(keys[near] == made[:, 2], short[near], made[:, 2] + 120))
        symbols = np.concatenate([samples[literal], 256 + size])
        green = code_lengths(np.bincount(symbols, minlength=ALPHABETS[0]), LONGEST)
        distance = code_lengths(np.bincount(far, minlength=ALPHABETS[4]), LONGEST)
        self.put(0, 2 if main else 1)  # no cache, no groups
        self.code(green)
        for value in rest:
            self.put(0b101, 3)
            self.put(value, 8)
        self.code(distance)
        plain = lambda lengths: np.where(np.count_nonzero(lengths) > 1, lengths, 0)  # noqa: E731  (one symbol takes no bits)
        k = len(literal)
        word, size = code_words(green)[symbols], plain(green)[symbols]
        copied = np.stack([word[k:], size_extra, code_words(distance)[far], far_extra], axis=1).ravel()
        taken = np.stack([size[k:], size_bits, plain(distance)[far], far_bits], axis=1).ravel()
        order = np.concatenate([literal, made[:, 0].repeat(4)]).argsort(kind="stable")
        self.extend(np.concatenate([word[:k], copied])[order], np.concatenate([size[:k], taken])[order])

    def bits(self) -> np.ndarray:
        self.extend(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        values, sizes = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        some = sizes > 0
        values, sizes = values[some], sizes[some]
        ends = sizes.cumsum()
        place = np.arange(int(ends[-1])) - (ends - sizes).repeat(sizes)
        return (values.repeat(sizes) >> place & 1).astype(np.uint8)


def forms(samples: np.ndarray, width: int = ROW) -> list[tuple[str, np.ndarray]]:
    """``(name, bits)`` of the forms of a grey image that may be the shortest; the subtract-green transform is in all.

    Plain; a palette, if there are at most 16 values; prediction by the left or the upper sample, if that leaves
    fewer different values.
    """
    height = len(samples) // width
    image = samples.reshape(height, width)
    head = [(width - 1, 14), (height - 1, 14), (0, 4), (1 | SUBTRACT_GREEN << 1, 3)]
    out = []

    def add(name: str, steps, values: np.ndarray, across: int, alpha: int) -> None:
        made = _Out()
        for value, size in head:
            made.put(value, size)
        steps(made)
        made.put(0, 1)
        made.grey(values.ravel(), across, (0, 0, alpha), True)
        out.append((name, made.bits()))

    add("plain", lambda made: None, image, width, 255)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    if 1 < len(colours) <= 16:
        shift = _bundle(len(colours))
        number = np.searchsorted(colours, image).astype(np.uint8).reshape(height, width >> shift, 1 << shift)
        packed = (number << (np.arange(1 << shift, dtype=np.uint8) * np.uint8(8 >> shift))).sum(axis=2).astype(np.uint8)

        def palette(made: _Out) -> None:
            made.put(1 | PALETTE << 1, 3)
            made.put(len(colours) - 1, 8)
            made.put(0, 1)  # colours as differences of the colour before: no cache, and alpha is 255 once
            green = _flat(np.diff(colours, prepend=0), ALPHABETS[0])
            made.code(green)
            for lengths in (_flat(np.zeros(1, dtype=np.int64), 256), _flat(np.zeros(1, dtype=np.int64), 256), _flat(np.array([0, 255]), 256), _flat(np.zeros(1, dtype=np.int64), ALPHABETS[4])):
                made.code(lengths)
            words, single = code_words(green), np.count_nonzero(green) == 1
            for k, step in enumerate(np.diff(colours, prepend=0).tolist()):
                made.put(int(words[step]), 0 if single else int(green[step]))
                made.put(int(k == 0), 1)  # of 0 and 255 the second

        add("palette", palette, packed, width >> shift, 255)
    elif len(colours) > 1:
        left, upper = image.copy(), image.copy()
        left[:, 1:] -= image[:, :-1]
        left[1:, 0] -= image[:-1, 0]
        upper[1:] -= image[:-1]
        upper[0] = left[0]
        for name, mode, values in (("left", 1, left), ("upper", 2, upper)):
            if np.count_nonzero(np.bincount(values.ravel(), minlength=256)) < len(colours):

                def predictor(made: _Out, mode=mode) -> None:
                    made.put(1 | PREDICTOR << 1, 3)
                    made.put(7, 3)  # blocks of 512 samples a side
                    made.grey(np.full(-(-height // 512) * -(-width // 512), mode, dtype=np.uint8), -(-width // 512), (0, 0, 255), False)

                add(name, predictor, values, width, 0)
    return out


def _flat(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Lengths of a code of those symbols."""
    return code_lengths(np.bincount(symbols, minlength=alphabet), LONGEST)


def encode_gray(samples: np.ndarray, width: int = ROW) -> bytes:
    """A grey image of 8-bit samples in the shortest of its :func:`forms`."""
    return riff(min((bits for _, bits in forms(samples, width)), key=len))


def store(payload: bytes) -> bytes:
    """A payload (its length a positive multiple of ROW) as one image, or several if it is very long."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(encode_gray(samples[at : at + ROW * ROWS]) for at in range(0, len(samples), ROW * ROWS))


def load(media: bytes) -> bytes:
    return b"".join(np.ascontiguousarray(decode_image(x)[:, :, GREEN]).tobytes() for x in images(media))


def pad(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data)), len(data)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and which of 64 equal stretches are above the mean."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(samples)))
    means = np.add.reduceat(samples.astype(np.int64), np.arange(64) * (len(samples) // 64)) * 1.0
    above = int(sum(1 << k for k in np.flatnonzero(means > means.mean()).tolist()))
    return f"{mean:.4f}|{spread:.4f}|{abs(float((share * np.log2(share)).sum())):.4f}|{above:016x}"


def media_column(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text's UTF-8, padded with zeros to a positive multiple of 64, as
    lossless WebP. Null text is empty. Equal texts give equal media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                made = [pad(t.as_py()) for t in b.column("text").slice(at, 256)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 256), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """``(doc_id, image, height, width, pixels)`` of every image in ``media(doc_id, media)``; pixels are bytes in
    the order red, green, blue, alpha. Null media gives no row; broken media raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                for k, x in enumerate(images(data or b"")):
                    p = decode_image(x)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], b.schema.field("doc_id").type), "image": pa.array([k], pa.int32()), "height": pa.array([p.shape[0]], pa.int32()), "width": pa.array([p.shape[1]], pa.int32()), "pixels": pa.array([p[:, :, [RED, GREEN, BLUE, ALPHA]].tobytes()], pa.binary())})

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, image int, height int, width int, pixels binary")


def media_report(docs: DataFrame) -> DataFrame:
    """Digest of the media column: what is read back from the stored images, and their feature.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Null text
    is empty, repeated rows agree, no rows give none. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b.column("media"):
                data = media.as_py()
                back = load(data)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(back, dtype=np.uint8))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = media_column(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
