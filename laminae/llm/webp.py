"""Lossless WebP: a decoder of the whole format, an encoder, and a store for byte payloads as 8-bit samples.

``decode`` reads any lossless file: prefix codes and their groups, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. The store writes a payload as a grey image and chooses by content:
a palette with samples bundled into bytes, predictor modes by block, back-references to any earlier samples, whatever
makes the shortest file. ``decode_grey`` decodes thousands of such images in lockstep, one sample of every image at a
step, with numpy table lookups, and inverts their transforms by rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed values of the format: order of the code-length code's lengths, and near pixels of short distance codes (x, y).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
SIDE = 16384
#: Samples a row of a stored payload has.
ROW = 576
#: Bits of the longest code that the store writes: its tables stay small.
STORE_BITS = 9
FAR_BITS = 8
#: Shortest back-reference that the store looks for, and the longest of the format.
SHORTEST, LONGEST = 8, 4096
#: Samples among which references are looked for, and tokens that are written at a time.
STRETCH = 1 << 20
#: Odd factor that brings the bits of a window to the top of 64.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Images, at least, that are decoded in lockstep; fewer are each decoded to their end, which takes less time from there.
TOGETHER = 300
#: Images in lockstep at most, of alike sizes: their tables stay in a core's cache.
GROUP = 2048
#: Predictor modes that the store chooses from (black, left, top, top-left), and the bits of its blocks' sides.
STORE_MODES = (0, 1, 2, 4)
BLOCK_BITS = 6
PAYLOADS_AT_ONCE = 16 << 20


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class BitWriter:
    def __init__(self):
        self.value, self.bits = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n


# prefix codes


#: More than any sum of counts.
NEVER = float("inf")


def code_lengths(counts: Iterable[int], limit: int) -> list[int]:
    """Huffman lengths of at most ``limit`` bits; 0 for unused symbols, 1 for a lone one."""
    counts = list(counts)
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            lengths[s] = 1
        return lengths
    weights = {s: counts[s] for s in used}
    while True:
        leaves = sorted(used, key=weights.__getitem__)
        n = len(leaves)
        sums = [*(weights[s] for s in leaves), NEVER]
        joins = [NEVER] * n
        parents, leaf, node = [0] * (2 * n - 1), 0, 0
        for new in range(n - 1):  # joins rise, so the least of all is the next leaf or the next join
            if (one := sums[leaf]) <= (other := joins[node]):
                parents[leaf] = n + new
                leaf += 1
            else:
                parents[n + node], one = n + new, other
                node += 1
            if (two := sums[leaf]) <= (other := joins[node]):
                parents[leaf] = n + new
                leaf += 1
            else:
                parents[n + node], two = n + new, other
                node += 1
            joins[new] = one + two
        level = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            level[k] = level[parents[k]] + 1
        if max(level[:n]) <= limit:
            break
        weights = {s: (w + 1) // 2 + 1 for s, w in weights.items()}
    for s, d in zip(leaves, level[:n], strict=True):
        lengths[s] = d
    return lengths


#: Numbers of 15 bits, the most of a code, with their bits reversed.
_REVERSED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)]


def reversed_codes(lengths: list[int]) -> list[int]:
    """Canonical codes, bits reversed, as the stream holds them."""
    out, code, previous = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - previous
        out[s] = _REVERSED[code] >> (15 - n)
        code, previous = code + 1, n
    return out


class PrefixCode:
    """Lookup by the next ``bits`` bits: symbol and length. A lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) < 2:
            self.bits, self.table, self.only = 0, [(used[0] if used else 0, 0)], used[0] if used else 0
            return
        self.only = None
        self.bits = max(lengths)
        if sum(1 << (self.bits - n) for n in lengths if n) != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        table: list = [None] * (1 << self.bits)
        for s, code in enumerate(reversed_codes(lengths)):
            if n := lengths[s]:
                table[code :: 1 << n] = [(s, n)] * (1 << (self.bits - n))
        self.table = table

    def read(self, reader: BitReader) -> int:
        symbol, n = self.table[reader.peek(self.bits)]
        reader.at += n
        return symbol


#: Of the symbols that repeat a code length: how many bits follow and the fewest repeats.
_REPEATS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}


def read_prefix_code(reader: BitReader, size: int) -> list[int]:
    lengths = [0] * size
    if reader.read(1):
        two, wide = reader.read(1), reader.read(1)
        lengths[reader.read(8 if wide else 1)] = 1
        if two:
            lengths[reader.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + reader.read(4)):
        own[CODE_LENGTH_ORDER[k]] = reader.read(3)
    code = PrefixCode(own)
    left = 2 + reader.read(2 + 2 * reader.read(3)) if reader.read(1) else size
    at, last = 0, 8
    table, mask, data = code.table, (1 << code.bits) - 1, reader.data
    byte, held, bits = reader.at >> 3, 0, -(reader.at & 7)
    while at < size and left:
        left -= 1
        if bits < 14:  # a symbol and what follows it
            if bits < 0:
                held, bits = int.from_bytes(data[byte : byte + 6], "little") >> -bits, 48 + bits
            else:
                held |= int.from_bytes(data[byte : byte + 6], "little") << bits
                bits += 48
            byte += 6
        symbol, n = table[held & mask]
        held >>= n
        bits -= n
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
        else:
            n, least = _REPEATS[symbol]
            repeat = least + (held & ((1 << n) - 1))
            held >>= n
            bits -= n
            if at + repeat > size:
                raise ValueError("code lengths run over")
            if symbol == 16:
                lengths[at : at + repeat] = [last] * repeat
            at += repeat
    reader.at = 8 * byte - bits
    return lengths


_SAME = re.compile(rb"(.)\1*", re.S)


def _write_lone_code(out: BitWriter, symbol: int) -> None:
    for value, bits in ((1, 1), (0, 1), (int(symbol > 1), 1), (symbol, 8 if symbol > 1 else 1)):
        out.write(value, bits)


def write_prefix_code(out: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2 and (not used or used[0] < 256):
        _write_lone_code(out, used[0] if used else 0)
        return
    runs: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    for same in _SAME.finditer(bytes(lengths)):
        start, end = same.span()
        n, count = lengths[start], end - start
        if n:
            runs.append((n, 0, 0))
            count -= 1
        while count:
            if n and count >= 3:
                step = min(count, 6)
                runs.append((16, step - 3, 2))
            elif not n and count >= 11:
                step = min(count, 138)
                runs.append((18, step - 11, 7))
            elif not n and count >= 3:
                step = min(count, 10)
                runs.append((17, step - 3, 3))
            else:
                step = 1
                runs.append((n, 0, 0))
            count -= step
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts, 7)
    codes = reversed_codes(own)
    alone = sum(n > 0 for n in own) == 1
    shown = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1
    out.write(0, 1)
    out.write(max(shown, 4) - 4, 4)
    out.write(sum(own[s] << 3 * k for k, s in enumerate(CODE_LENGTH_ORDER[: max(shown, 4)])), 3 * max(shown, 4))
    value, at = 0, 1
    widths = [0] * 19 if alone else own
    for s, extra, bits in runs:
        n = widths[s]
        value |= (codes[s] | extra << n) << at if n else extra << at
        at += n + bits
    out.write(value, at)


def read_number(reader: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + reader.read(extra) + 1


def number_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = (value >> (top - 1)) & 1
    return 2 * top + second, value & ((1 << (top - 1)) - 1), top - 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# images of 32-bit ARGB pixels


def _read_groups(reader: BitReader, n: int, cache_bits: int) -> list[list[PrefixCode]]:
    sizes = (256 + LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    return [[PrefixCode(read_prefix_code(reader, size)) for size in sizes] for _ in range(n)]


def _read_image(reader: BitReader, width: int, height: int, main: bool) -> list[int]:
    cache_bits = reader.read(4) if reader.read(1) else 0
    tiles, tile_bits, across = None, 0, 0
    if main and reader.read(1):
        tile_bits = reader.read(3) + 2
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        down = (height + (1 << tile_bits) - 1) >> tile_bits
        tiles = [(p >> 8) & 0xFFFF for p in _read_image(reader, across, down, False)]
    groups = _read_groups(reader, max(tiles) + 1 if tiles else 1, cache_bits)
    return _read_pixels(reader, width, height, groups, cache_bits, tiles, tile_bits, across)


def _read_pixels(reader, width, height, groups, cache_bits, tiles, tile_bits, across) -> list[int]:
    total, out = width * height, []
    cache = [0] * (1 << cache_bits)
    shift, cached = 32 - cache_bits, 0

    def keep():
        nonlocal cached
        for p in out[cached:]:
            cache[((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = p
        cached = len(out)

    group = groups[0]
    while len(out) < total:
        if tiles:
            y, x = divmod(len(out), width)
            group = groups[tiles[(y >> tile_bits) * across + (x >> tile_bits)]]
        symbol = group[0].read(reader)
        if symbol < 256:
            red, blue, alpha = group[1].read(reader), group[2].read(reader), group[3].read(reader)
            out.append((alpha << 24) | (red << 16) | (symbol << 8) | blue)
        elif symbol < 256 + LENGTH_SYMBOLS:
            length = read_number(reader, symbol - 256)
            back = distance_of(read_number(reader, group[4].read(reader)), width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("back-reference outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            keep()
            out.append(cache[symbol - 256 - LENGTH_SYMBOLS])
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(parts: Iterable[int]) -> int:
    a, r, g, b = parts
    return ((a & 255) << 24) | ((r & 255) << 16) | ((g & 255) << 8) | (b & 255)


def _mean(p: int, q: int) -> int:
    return _join((a + b) >> 1 for a, b in zip(_split(p), _split(q), strict=True))


def _clamp(v: int) -> int:
    return min(max(v, 0), 255)


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    if mode == 11:
        from_top = sum(abs(t - c) for t, c in zip(_split(top), _split(top_left), strict=True))
        from_left = sum(abs(n - c) for n, c in zip(_split(left), _split(top_left), strict=True))
        return left if from_top < from_left else top
    if mode == 12:
        return _join(_clamp(a + b - c) for a, b, c in zip(_split(left), _split(top), _split(top_left), strict=True))
    if mode == 13:
        halves = zip(_split(_mean(left, top)), _split(top_left), strict=True)
        return _join(_clamp(a + int((a - b) / 2)) for a, b in halves)
    simple = {1: left, 2: top, 3: top_right, 4: top_left}
    if mode in simple:
        return simple[mode]
    pairs = {6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}
    if mode in pairs:
        return _mean(*pairs[mode])
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    return 0xFF000000


def _predicted(pixels: list[int], at: int, width: int, mode: int) -> int:
    y, x = divmod(at, width)
    if not y:
        return pixels[at - 1] if x else 0xFF000000
    if not x:
        return pixels[at - width]
    return predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _tile(image: list[int], at: int, width: int, bits: int) -> int:
    y, x = divmod(at, width)
    return image[(y >> bits) * ((width + (1 << bits) - 1) >> bits) + (x >> bits)]


def _delta(a: int, b: int) -> int:
    return (((a ^ 128) - 128) * ((b ^ 128) - 128)) >> 5


def _cross(p: int, tile: int, undo: bool) -> int:
    a, r, g, b = _split(p)
    _, red_to_blue, green_to_blue, green_to_red = _split(tile)
    sign = 1 if undo else -1
    new_red = (r + sign * _delta(green_to_red, g)) & 255
    return _join((a, new_red, g, b + sign * (_delta(green_to_blue, g) + _delta(red_to_blue, new_red if undo else r))))


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo(kind: int, pixels: list[int], width: int, detail) -> list[int]:
    if kind == SUBTRACT_GREEN:
        return [_join((p >> 24, (p >> 16) + (p >> 8), p >> 8, p + (p >> 8))) for p in pixels]
    if kind == PALETTE:
        colours, bits = detail
        packed, each = (width + (1 << bits) - 1) >> bits, 8 >> bits
        height, mask = len(pixels) // packed, (1 << each) - 1
        out = []
        for y in range(height):
            for x in range(width):
                index = ((pixels[y * packed + (x >> bits)] >> 8) & 255) >> (each * (x & ((1 << bits) - 1))) & mask
                out.append(colours[index] if index < len(colours) else 0)
        return out
    bits, image = detail
    if kind == CROSS_COLOUR:
        return [_cross(p, _tile(image, at, width, bits), True) for at, p in enumerate(pixels)]
    out = []
    for at, p in enumerate(pixels):
        guess = _predicted(out, at, width, (_tile(image, at, width, bits) >> 8) & 15)
        out.append(_join(a + b for a, b in zip(_split(p), _split(guess), strict=True)))
    return out


def _chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out[data[at : at + 4]] = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def _header(body: bytes):
    """(reader after the transforms, width, height, packed width, transforms)."""
    reader = BitReader(body)
    if reader.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = reader.read(14) + 1, reader.read(14) + 1
    reader.read(1)
    if reader.read(3):
        raise ValueError("unknown version")
    inner, transforms = width, []
    while reader.read(1):
        kind = reader.read(2)
        detail = None
        at_width = inner
        if kind == PALETTE:
            size = reader.read(8) + 1
            colours = _read_image(reader, size, 1, False)
            for k in range(1, size):
                colours[k] = _join(a + b for a, b in zip(_split(colours[k]), _split(colours[k - 1]), strict=True))
            bits = _pack_bits(size)
            detail, inner = (colours, bits), (inner + (1 << bits) - 1) >> bits
        elif kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.read(3) + 2
            across, down = (inner + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            detail = bits, _read_image(reader, across, down, False)
        transforms.append((kind, at_width, detail))
    return reader, width, height, inner, transforms


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file: (height, width, 4) of red, green, blue, alpha."""
    reader, width, height, inner, transforms = _header(_chunks(data)[b"VP8L"])
    pixels = _read_image(reader, inner, height, True)
    for kind, at_width, detail in reversed(transforms):
        pixels = _undo(kind, pixels, at_width, detail)
    words = np.array(pixels, np.uint32).reshape(height, width)
    return np.stack([(words >> s) & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)


def _file(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def _start(width: int, height: int, alpha: bool) -> BitWriter:
    out = BitWriter()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        out.write(value, bits)
    return out


def _write_image(out: BitWriter, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, tile_bits: int = 0) -> None:
    """Greedy runs of one earlier pixel or row as references, then colour cache, then literals."""
    tokens, cache, at = [], {}, 0
    while at < len(pixels):
        length, code = 0, 0
        for near, back in ((2, 1), (1, width)) if references else ():
            n = 0
            while at >= back and at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - back]:
                n += 1
            if n > length:
                length, code = n, near
        p = pixels[at]
        key = ((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            tokens.append((at, "back", length, code))
        elif cache_bits and cache.get(key) == p:
            tokens.append((at, "cache", key, 0))
            length = 1
        else:
            tokens.append((at, "pixel", p, 0))
            length = 1
        for p in pixels[at : at + length]:
            if cache_bits:
                cache[((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += length
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    across, groups = 0, 1
    if main:
        out.write(int(tile_bits > 0), 1)
        if tile_bits:
            out.write(tile_bits - 2, 3)
            across, down = (width + (1 << tile_bits) - 1) >> tile_bits, (len(pixels) // width + (1 << tile_bits) - 1) >> tile_bits
            tiles, groups = [k % 2 for k in range(across * down)], 2
            _write_image(out, [0xFF000000 | (t << 8) for t in tiles], across, False)

    def group_of(at: int) -> int:
        y, x = divmod(at, width)
        return tiles[(y >> tile_bits) * across + (x >> tile_bits)] if groups > 1 else 0

    counts = [[[0] * (256 + LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0)), *([0] * 256 for _ in range(3)), [0] * DISTANCE_SYMBOLS] for _ in range(groups)]
    steps = []
    for at, kind, value, code in tokens:
        if kind == "pixel":
            a, r, g, b = _split(value)
            parts = [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif kind == "cache":
            parts = [(0, 256 + LENGTH_SYMBOLS + value, 0, 0)]
        else:
            symbol, *extra = number_symbol(value)
            far, *more = number_symbol(code)
            parts = [(0, 256 + symbol, *extra), (4, far, *more)]
        for which, symbol, _, _ in parts:
            counts[group_of(at)][which][symbol] += 1
        steps.append((group_of(at), parts))
    lengths = [[code_lengths(c, 15) for c in group] for group in counts]
    for group in lengths:
        for own in group:
            write_prefix_code(out, own)
    codes = [[reversed_codes(n) for n in group] for group in lengths]
    alone = [[sum(x > 0 for x in n) < 2 for n in group] for group in lengths]
    for group, parts in steps:
        for which, symbol, extra, bits in parts:
            if not alone[group][which]:
                out.write(codes[group][which][symbol], lengths[group][which][symbol])
            out.write(extra, bits)


def encode(image: np.ndarray, modes: list[int] | None = None, cross: list[int] | None = None, palette: bool = False, subtract_green: bool = False, cache_bits: int = 0, references: bool = True, tile_bits: int = 0, block_bits: int = 2) -> bytes:
    """A lossless WebP file of (height, width, 4) pixels with the transforms asked for.

    ``modes``: predictor modes, dealt to blocks in turn. ``cross``: colour multipliers, likewise. For whole-feature
    files of moderate size; ``encode_grey`` is the fast way for byte payloads.
    """
    height, width = image.shape[:2]
    r, g, b, a = (image[..., k].astype(np.uint32).reshape(-1) for k in range(4))
    pixels = ((a << 24) | (r << 16) | (g << 8) | b).tolist()
    out = _start(width, height, True)
    if palette:
        colours = sorted(set(pixels))
        if len(colours) > 256:
            raise ValueError("a palette holds 256 colours")
        bits = _pack_bits(len(colours))
        each, packed = 8 >> bits, (width + (1 << bits) - 1) >> bits
        place = {c: k for k, c in enumerate(colours)}
        small = [0xFF000000] * (packed * height)
        for at, p in enumerate(pixels):
            y, x = divmod(at, width)
            small[y * packed + (x >> bits)] |= place[p] << (8 + each * (x & ((1 << bits) - 1)))
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(colours) - 1, 8)
        steps = [_join(c - d for c, d in zip(_split(n), _split(m), strict=True)) for m, n in zip([0, *colours], colours, strict=False)]
        _write_image(out, steps, len(steps), False)
        pixels, width = small, packed
    across, down = (width + (1 << block_bits) - 1) >> block_bits, (height + (1 << block_bits) - 1) >> block_bits
    if modes:
        image_of = [0xFF000000 | (modes[k % len(modes)] << 8) for k in range(across * down)]
        out.write(1, 1)
        out.write(PREDICTOR, 2)
        out.write(block_bits - 2, 3)
        _write_image(out, image_of, across, False)
        pixels = [_join(x - y for x, y in zip(_split(p), _split(_predicted(pixels, at, width, (_tile(image_of, at, width, block_bits) >> 8) & 15)), strict=True)) for at, p in enumerate(pixels)]
    if cross:
        image_of = [0xFF000000 | cross[k % len(cross)] for k in range(across * down)]
        out.write(1, 1)
        out.write(CROSS_COLOUR, 2)
        out.write(block_bits - 2, 3)
        _write_image(out, image_of, across, False)
        pixels = [_cross(p, _tile(image_of, at, width, block_bits), False) for at, p in enumerate(pixels)]
    if subtract_green:
        out.write(1, 1)
        out.write(SUBTRACT_GREEN, 2)
        pixels = [_join((p >> 24, (p >> 16) - (p >> 8), p >> 8, p - (p >> 8))) for p in pixels]
    out.write(0, 1)
    _write_image(out, pixels, width, True, cache_bits, references, tile_bits)
    return _file(out.value.to_bytes((out.bits + 7) // 8, "little"))


# grey images of byte payloads


def grey_shape(n: int) -> tuple[int, int] | None:
    """(width, height) of a payload of ``n`` samples, a positive multiple of ROW; none if one image cannot hold it."""
    rows = n // ROW
    times = next((k for k in range(1, SIDE // ROW + 1) if rows % k == 0 and rows // k <= SIDE), None)
    return None if times is None else (ROW * times, rows // times)


def padded(text: bytes) -> np.ndarray:
    """``text`` and bytes 255 up to a positive multiple of ROW."""
    rows = max(1, -(-len(text) // ROW))
    out = np.full(rows * ROW, 255, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def images_of(samples: np.ndarray) -> list[np.ndarray]:
    """``samples`` cut into payloads of one image each; only the last is not a full SIDE rows of ROW."""
    return [samples[at : at + SIDE * ROW] for at in range(0, len(samples), SIDE * ROW)] if grey_shape(len(samples)) is None else [samples]


def _repeats(samples: np.ndarray) -> np.ndarray:
    """Rows (start, length, distance) of back-references, in order and apart: runs at one distance to the last equal window."""
    if len(samples) > STRETCH:
        return np.concatenate([_repeats(samples[at : at + STRETCH]) + (at, 0, 0) for at in range(0, len(samples), STRETCH)])
    if len(samples) < SHORTEST:
        return np.zeros((0, 3), np.int64)
    windows = len(samples) - SHORTEST + 1
    keys = np.ndarray((windows,), "<u8", np.ascontiguousarray(samples).tobytes(), 0, (1,)).copy()
    # equal windows stand together in order of position; whether neighbours are equal is seen from the windows themselves
    order = (np.sort((keys * MIX & ~np.uint64(STRETCH - 1)) | np.arange(windows, dtype=np.uint64)) & np.uint64(STRETCH - 1)).astype(np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    back = np.zeros(windows, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    cuts = np.flatnonzero(back[1:] != back[:-1]) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, windows) + SHORTEST - 1
    used = back[starts] > 0
    out, at = [], 0
    for start, end, far in zip(starts[used].tolist(), ends[used].tolist(), back[starts[used]].tolist(), strict=True):
        start = max(start, at)
        while end - start >= SHORTEST:
            at = min(end, start + LONGEST)
            out.append((start, at - start, far))
            start = at
    return np.array(out, np.int64).reshape(-1, 3)


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that symbols of such counts take, over the last axis."""
    counts = counts.astype(np.float64)
    return (counts * np.log2(np.maximum(counts.sum(-1, keepdims=True), 1) / np.maximum(counts, 1))).sum(-1)


def _number_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``number_symbol`` of many values."""
    less = values - 1
    top = np.frexp(np.maximum(less, 1).astype(np.float64))[1] - 1
    bits = np.where(values <= 4, 0, top - 1)
    return np.where(values <= 4, less, 2 * top + (less >> np.maximum(top - 1, 0) & 1)), np.where(values <= 4, 0, less & ((1 << np.maximum(bits, 0)) - 1)), bits


def _residuals(image: np.ndarray, mode: int) -> np.ndarray:
    """Grey ``image`` less its prediction; the first row and column have predictions of their own, as in the format."""
    out = image.copy()
    out[0, 1:] -= image[0, :-1]
    out[1:, 0] -= image[:-1, 0]
    if mode == 1:
        out[1:, 1:] -= image[1:, :-1]
    elif mode == 2:
        out[1:, 1:] -= image[:-1, 1:]
    elif mode == 4:
        out[1:, 1:] -= image[:-1, :-1]
    return out


_N_LOG_N = np.append(0, np.arange(1, (1 << 2 * BLOCK_BITS) + 1) * np.log2(np.arange(1, (1 << 2 * BLOCK_BITS) + 1)))


def _predictors(image: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(modes of blocks, residuals) by the entropy of each block; none if hardly less than that of the samples.

    Blocks are looked at if any mode by itself lessens the entropy of the whole image.
    """
    others = [_residuals(image, mode) for mode in STORE_MODES[1:]]
    whole = _entropy(np.stack([np.bincount(values.reshape(-1), minlength=256) for values in (image, *others)]))
    if whole[1:].min() > whole[0]:
        return None
    tried = np.stack([_residuals(image, STORE_MODES[0]), *others])
    height, width = image.shape
    across = (width + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
    block = (np.arange(height, dtype=np.int32) >> BLOCK_BITS)[:, None] * across + (np.arange(width, dtype=np.int32) >> BLOCK_BITS)
    blocks = int(block[-1, -1]) + 1
    at = block << 8
    # a block's size is the same for all, so the sum of n log n ranks their entropies
    known = np.stack([_N_LOG_N[np.bincount((at + values).reshape(-1), minlength=256 * blocks)].reshape(blocks, 256).sum(1) for values in (image, *tried)])
    size = np.bincount(block.reshape(-1))
    bits = size * np.log2(size) - known
    if bits[1:].min(0).sum() > 0.9 * bits[0].sum():
        return None
    best = bits[1:].argmin(0)
    return np.array(STORE_MODES)[best], np.take_along_axis(tried, best[block][None], 0)[0]


def _unpredicted(residuals: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of the predictor modes 0 to 4 for grey residuals, by stretches of a row inside a block."""
    height, width = residuals.shape
    across = (width + (1 << bits) - 1) >> bits
    out = residuals.copy()
    out[0] = np.cumsum(residuals[0], dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[:1] += above[:1]
        for k in range(across):
            mode, lo, hi = modes[(y >> bits) * across + k], max(1, k << bits), min(width, (k + 1) << bits)
            if mode == 1:
                row[lo:hi] = np.cumsum(row[lo:hi], dtype=np.uint8) + row[lo - 1]
            elif mode == 2:
                row[lo:hi] += above[lo:hi]
            elif mode == 3:  # beyond the last column stands this row's first sample
                row[lo:hi] += np.append(above, row[0])[lo + 1 : hi + 1]
            elif mode == 4:
                row[lo:hi] += above[lo - 1 : hi - 1]
    return out


def _or_bits(low: np.ndarray, value: np.ndarray, at: np.ndarray) -> None:
    """Sets ``value`` (under 32 bits each, apart, in order) from the bits ``at`` on in the 32-bit words ``low``."""
    base = int(at[0]) >> 5
    wide = value >> np.uint64(16)
    for x, first in ((value & np.uint64(0xFFFF), at), (wide, at + 16)) if wide.any() else ((value, at),):
        # every part lies in the 32-bit word where it starts and the next; sums of disjoint bits below 2**53 are exact
        words = np.bincount((first >> 5) - base, weights=(x << (first & 31).astype(np.uint64)).astype(np.float64)).astype(np.uint64)
        low[base : base + len(words)] |= (words & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low[base + 1 : base + 1 + len(words)] |= (words >> np.uint64(32)).astype(np.uint32)


def _write_grey(out: BitWriter, symbols: np.ndarray, width: int, alpha: int) -> bytes:
    """The file of ``out`` and the main image of green ``symbols``: literals, and back-references where they take fewer bits."""
    for value in (0, 0, 0):  # no more transforms, no colour cache, one group of codes
        out.write(value, 1)
    plain = np.bincount(symbols, minlength=256 + LENGTH_SYMBOLS)
    found = _repeats(symbols)
    starts, sizes, far = found.T
    numbers = _number_symbols(np.stack([sizes, np.where(far == 1, 2, np.where(far == width, 1, far + len(NEAR)))]))
    (size_symbol, far_symbol), (size_extra, far_extra), (size_bits, far_bits) = numbers
    covered = np.zeros(len(symbols) + 1, np.int8)
    covered[starts] += 1
    covered[starts + sizes] -= 1
    first = np.cumsum(covered[:-1], dtype=np.int8) == 0
    stream = symbols.astype(np.uint16)
    literal = np.bincount(stream[first], minlength=256 + LENGTH_SYMBOLS)
    counts, far_counts = literal + np.bincount(256 + size_symbol, minlength=256 + LENGTH_SYMBOLS), np.bincount(far_symbol, minlength=DISTANCE_SYMBOLS)
    if not len(found) or _entropy(plain) <= _entropy(counts) + _entropy(far_counts) + (size_bits + far_bits).sum():
        starts, counts, far_counts, first = starts[:0], plain, far_counts * 0, np.ones(len(symbols), bool)
    far_counts[1] += not far_counts.any()
    lengths, far_lengths = code_lengths(counts.tolist(), STORE_BITS), code_lengths(far_counts.tolist(), FAR_BITS)
    write_prefix_code(out, lengths)
    for only in (0, 0, alpha):  # red, blue, alpha
        _write_lone_code(out, only)
    write_prefix_code(out, far_lengths)
    codes, bits = np.array(reversed_codes(lengths), np.uint64), np.array(lengths, np.int64)
    far_codes, far_code_bits = np.array(reversed_codes(far_lengths), np.uint64), np.array(far_lengths, np.int64)
    for own in (bits, far_code_bits):
        own *= (own > 0).sum() > 1  # a lone symbol takes none
    many = len(starts)
    stream[starts] = 256 + size_symbol[:many]
    first[starts] = True
    token = np.flatnonzero(first)
    # what follows a length symbol: its extra bits, the distance symbol, its extra bits
    behind = [(x[:many], n[:many]) for x, n in ((size_extra, size_bits), (far_codes[far_symbol], far_code_bits[far_symbol]), (far_extra, far_bits))]
    end = out.bits + int((counts * bits).sum()) + sum(int(n.sum()) for _, n in behind)
    low, at = np.zeros((end >> 5) + 5, np.uint32), out.bits
    of_match = np.searchsorted(token, starts)
    for lo in range(0, len(token), STRETCH):
        part = stream[token[lo : lo + STRETCH]]
        begin, stop = np.searchsorted(of_match, (lo, lo + STRETCH))
        fields = np.ones(len(part), np.int64)
        fields[of_match[begin:stop] - lo] = 4
        place = np.cumsum(fields) - fields
        value, size = np.zeros(int(fields.sum()), np.uint64), np.zeros(int(fields.sum()), np.int64)
        value[place], size[place] = codes[part], bits[part]
        for k, (x, n) in enumerate(behind, 1):
            where = place[of_match[begin:stop] - lo] + k
            value[where], size[where] = x[begin:stop], n[begin:stop]
        value[size == 0] = 0
        ends = at + np.cumsum(size)
        _or_bits(low, value, ends - size)
        at = int(ends[-1])
    raw = bytearray(low.tobytes())
    head = out.value.to_bytes((out.bits + 7) // 8, "little")
    raw[: len(head) - 1] = head[:-1]
    raw[len(head) - 1] |= head[-1]
    return _file(bytes(raw[: (end + 7) // 8]))


def encode_grey(samples: np.ndarray) -> bytes:
    """The shortest lossless WebP file of grey samples that the store's forms give: plain, by predictors, by a palette.

    Of the other steps of the format, a colour cache and cross-colour can't shorten a grey image: a cached grey is one
    symbol as its literal is, and red and blue are nothing once green is subtracted.
    """
    width, height = grey_shape(len(samples))
    image = samples.reshape(height, width)
    out = _start(width, height, False)
    for value, bits in ((1, 1), (SUBTRACT_GREEN, 2)):
        out.write(value, bits)
    files = [_write_grey(out, samples, width, 255)]
    if (chosen := _predictors(image)) is not None:
        modes, residuals = chosen
        out = _start(width, height, False)
        for value, bits in ((1, 1), (SUBTRACT_GREEN, 2), (1, 1), (PREDICTOR, 2), (BLOCK_BITS - 2, 3)):
            out.write(value, bits)
        _write_image(out, [0xFF000000 | (mode << 8) for mode in modes.tolist()], (width + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS, False)
        files.append(_write_grey(out, residuals.reshape(-1), width, 0))
    greys = np.flatnonzero(np.bincount(samples, minlength=256))
    if bits := _pack_bits(len(greys)):
        out = _start(width, height, False)
        for value, n in ((1, 1), (PALETTE, 2), (len(greys) - 1, 8)):
            out.write(value, n)
        colours = [0xFF000000 | g * 0x010101 for g in greys.tolist()]
        steps = [_join(c - d for c, d in zip(_split(n), _split(m), strict=True)) for m, n in zip([0, *colours], colours, strict=False)]
        _write_image(out, steps, len(steps), False)
        index = np.searchsorted(greys, samples).astype(np.uint8).reshape(height, width >> bits, 1 << bits)
        bundled = np.bitwise_or.reduce(index << (np.arange(1 << bits, dtype=np.uint8) * (8 >> bits)), axis=2)
        files.append(_write_grey(out, bundled.reshape(-1), width >> bits, 255))
    return min(files, key=len)


def _lockstep(files: list[tuple[bytes, int, PrefixCode, PrefixCode, int, int]]) -> list[np.ndarray]:
    """Green symbols of images: (body, bit position, code, distance code, number, width), one of each image a step.

    An image inside a back-reference copies, another reads its next symbol. The last few are decoded one by one.
    """
    sizes = np.array([f[4] for f in files])
    order = np.argsort(-sizes, kind="stable")

    def tabled(which: int) -> tuple[np.ndarray, int]:
        bits = max(f[which].bits for f in files)
        tables = np.empty((len(files), 1 << bits), np.uint16)
        for k, i in enumerate(order):
            code = files[i][which]
            tables[k] = np.tile(np.array([(s << 4) | n for s, n in code.table], np.uint16), 1 << (bits - code.bits))
        return tables.reshape(-1), bits

    (tables, bits), (far_tables, far_bits) = tabled(2), tabled(3)
    bodies = [files[i][0] for i in order]
    base = np.cumsum([0] + [len(b) + 8 for b in bodies])
    data = np.frombuffer(b"".join(b + bytes(8) for b in bodies), np.uint8).astype(np.uint32)
    view = data.copy()
    view[:-1] |= data[1:] << 8
    view[:-2] |= data[2:] << 16
    widths = np.array([files[i][5] for i in order])
    near = np.array(NEAR)
    out = np.empty(int(sizes.sum()), np.uint8)
    ends = np.cumsum(sizes[order])
    place = ends - sizes[order]
    pos = base[:-1] * 8 + np.array([files[i][1] for i in order])
    mask, live = np.uint32((1 << bits) - 1), np.arange(len(files))
    at, row, stop = place.copy(), live << bits, ends.copy()
    left, back = np.zeros(len(files), np.int64), np.zeros(len(files), np.int64)

    def number(which: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        byte, turn = pos[which] >> 3, pos[which] & 7
        window = view[byte].astype(np.int64) | view[byte + 3].astype(np.int64) << 24
        pos[which] += extra
        return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + ((window >> turn) & ((1 << extra) - 1))) + 1

    while len(live) >= TOGETHER:
        for _ in range(int((stop - at).min())):
            reads = left == 0
            entry = tables[row + ((view[pos >> 3] >> (pos & 7).astype(np.uint32)) & mask)] * reads
            pos += entry & 15
            symbol = entry >> 4
            refers = np.flatnonzero(symbol > 255)
            if len(refers):
                left[refers] = number(refers, symbol[refers].astype(np.int64) - 256)
                far = far_tables[(live[refers] << far_bits) + ((view[pos[refers] >> 3] >> (pos[refers] & 7).astype(np.uint32)) & np.uint32((1 << far_bits) - 1))]
                pos[refers] += far & 15
                code = number(refers, (far >> 4).astype(np.int64))
                x, y = near[np.minimum(code, len(NEAR)) - 1].T
                back[refers] = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, x + y * widths[live[refers]]))
                if (back[refers] > at[refers] - place[live[refers]]).any() or (left[refers] > stop[refers] - at[refers]).any():
                    raise ValueError("back-reference outside the image")
            copies = left > 0
            out[at] = np.where(copies, out[at - back * copies], symbol)
            left -= copies
            at += 1
        going = at < stop
        live, at, pos, row, stop, left, back = (x[going] for x in (live, at, pos, row, stop, left, back))
    for k, *state in zip(live.tolist(), at.tolist(), pos.tolist(), left.tolist(), back.tolist(), strict=True):
        own = bytearray(out[place[k] : state[0]].tobytes())
        _to_the_end(own, files[order[k]], state[1] - 8 * int(base[k]), *state[2:])
        out[place[k] : ends[k]] = np.frombuffer(own, np.uint8)
    parts: list = [None] * len(files)
    for k, i in enumerate(order):
        parts[i] = out[place[k] : ends[k]]
    return parts


def _to_the_end(out: bytearray, file: tuple, pos: int, left: int, back: int) -> None:
    """Adds the symbols of ``file`` from the bit ``pos`` on, after the rest of a reference."""
    body, _, code, far_code, total, width = file
    table, mask = code.table, (1 << code.bits) - 1
    far_table, far_mask = far_code.table, (1 << far_code.bits) - 1
    byte, held, bits = (pos >> 3) + 6, int.from_bytes(body[pos >> 3 : (pos >> 3) + 6], "little") >> (pos & 7), 48 - (pos & 7)
    while True:
        if left:
            if not 0 < back <= len(out) or len(out) + left > total:
                raise ValueError("back-reference outside the image")
            out += (out[-back:] * (left // back + 1))[:left] if back < left else out[len(out) - back : len(out) - back + left]
            left = 0
        if len(out) >= total:
            return
        if bits < 16:
            held |= int.from_bytes(body[byte : byte + 6], "little") << bits
            byte, bits = byte + 6, bits + 48
        symbol, n = table[held & mask]
        held >>= n
        bits -= n
        if symbol < 256:
            out.append(symbol)
        else:
            held |= int.from_bytes(body[byte : byte + 6], "little") << bits
            byte, bits = byte + 6, bits + 48
            if (symbol := symbol - 256) < 4:
                left = symbol + 1
            else:
                n = (symbol - 2) >> 1
                left = ((2 + (symbol & 1)) << n) + (held & ((1 << n) - 1)) + 1
                held >>= n
                bits -= n
            symbol, n = far_table[held & far_mask]
            held >>= n
            bits -= n
            if symbol < 4:
                back = symbol + 1
            else:
                n = (symbol - 2) >> 1
                back = ((2 + (symbol & 1)) << n) + (held & ((1 << n) - 1)) + 1
                held >>= n
                bits -= n
            back = distance_of(back, width)


def _grey_of(symbols: np.ndarray, width: int, height: int, transforms: list[tuple]) -> np.ndarray:
    """Samples of a grey image of the store's forms, from its green symbols."""
    kind, _, detail = transforms[-1]
    if kind == PREDICTOR:
        bits, modes = detail
        return _unpredicted(symbols.reshape(height, width), (np.array(modes) >> 8) & 15, bits).reshape(-1)
    if kind == PALETTE:
        colours, bits = detail
        greens = np.zeros(256, np.uint8)
        greens[: len(colours)] = (np.array(colours) >> 8) & 255
        index = symbols.reshape(height, -1, 1) >> (np.arange(1 << bits, dtype=np.uint8) * (8 >> bits)) & ((1 << (8 >> bits)) - 1)
        return greens[index.reshape(height, -1)[:, :width]].reshape(-1)
    return symbols


def decode_grey(files: list[bytes]) -> list[np.ndarray]:
    """Grey samples of each file, row by row; files of other kinds than the store's go through ``decode``."""
    out: list = [None] * len(files)
    batch, which = [], []
    for k, data in enumerate(files):
        body = _chunks(data)[b"VP8L"]
        reader, width, height, inner, transforms = _header(body)
        kinds = [t[0] for t in transforms]
        simple = kinds in ([SUBTRACT_GREEN], [PALETTE]) or kinds == [SUBTRACT_GREEN, PREDICTOR] and all((m >> 8) & 15 < 5 for m in transforms[1][2][1])
        if simple and not reader.peek(2):
            reader.read(2)
            codes = _read_groups(reader, 1, 0)[0]
            if [c.only for c in codes[1:4]] == [0, 0, 0 if PREDICTOR in kinds else 255]:
                batch.append((body, reader.at, codes[0], codes[4], inner * height, inner))
                which.append((k, width, height, transforms))
                continue
        out[k] = decode(data)[..., 1].reshape(-1)
    order = sorted(range(len(batch)), key=lambda k: -batch[k][4])
    for at in range(0, len(order), GROUP):
        some = order[at : at + GROUP]
        for i, symbols in zip(some, _lockstep([batch[i] for i in some]), strict=True):
            k, *form = which[i]
            out[k] = _grey_of(symbols, *form)
    return out


def files_of(media: bytes) -> list[bytes]:
    """The files that ``media`` holds one after another; each tells its length in its RIFF header."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def feature(samples: np.ndarray, n: int) -> str:
    """Mean, deviation and entropy of the samples, and the commonest one, of a payload of ``n`` bytes."""
    counts = np.bincount(samples, minlength=256)
    shares = counts / len(samples)
    mean = float(shares @ np.arange(256))
    spread = float(shares @ (np.arange(256) - mean) ** 2) ** 0.5
    used = shares[counts > 0]
    return f"{len(samples) // ROW}x{ROW};mean={mean:.3f};sd={spread:.3f};entropy={float(-(used * np.log2(used)).sum()):.3f};mode={int(counts.argmax())};bytes={n}"


def _store(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for at in range(0, len(texts), 200):
            part = [t or b"" for t in texts[at : at + 200]]
            media = [b"".join(map(encode_grey, images_of(padded(t)))) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 200), pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _load(batches):
    def flush(held):
        media = [m for h in held for m in h[2]]
        files = [files_of(m) for m in media]
        images = iter(decode_grey([f for some in files for f in some]))
        samples = [np.concatenate(own) if len(own) > 1 else own[0] for own in ([next(images) for _ in some] for some in files)]
        ids, sizes = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        for at in range(0, len(media), 200):
            some = samples[at : at + 200]
            marks = [feature(s, n) for s, n in zip(some, sizes.slice(at, 200).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, 200), sizes.slice(at, 200), pa.array(media[at : at + 200], pa.binary()), pa.array([s.tobytes() for s in some], pa.binary()), pa.array(marks)], ["doc_id", "n_bytes", "media", "samples", "feature"])

    held, size = [], 0
    for batch in batches:
        media = batch.column("media").to_pylist()
        held.append((batch.column("doc_id"), batch.column("n_bytes"), media))
        size += sum(map(len, media))
        if size >= PAYLOADS_AT_ONCE:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, padded to a multiple of ROW, as a lossless WebP file."""
    prepare(docs)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: adds ``samples``, the decoded pixel array, and ``feature``.

    Null or empty texts are one row of 255. Equal texts have equal files and features. Repeated rows and null ids pass
    through, an empty table gives an empty one. One image holds up to 16384 rows of 576 x k samples; a text whose rows
    have no such shape (9 MB at least) is several files one after another, whose samples are joined again.
    """
    return media.mapInArrow(_load, "doc_id long, n_bytes long, media binary, samples binary, feature string")
