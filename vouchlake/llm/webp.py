"""Lossless WebP (VP8L): a decoder of the whole format and an encoder of grey images.

The decoder reads prefix codes (also several groups of them), back-references and the
colour cache, and inverts the predictor, cross-colour, subtract-green and palette
transforms. Streams in one channel, which is what the encoder writes, are decoded
without a loop over pixels: the end of the code word or back-reference that would start
at every bit is looked up at once, the chain of starts is followed by doubling, and only
back-references are copied one by one.

The encoder writes samples as they are, as differences to the left or upper neighbour,
or as indices into a palette, each as literals alone or with back-references, whichever
it reckons to be shortest. A colour cache and the transforms between channels can't
shorten an image of one channel, where a cached colour takes one symbol as a literal does.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np

# Fixed values of the format: order in which code length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (dx, dy) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
LONGEST = 11  # of the encoder's code words
SEEN, LONGEST_COPY = 8, 4096  # samples: the shortest and the longest copy the encoder writes
COPY_HEAD, TRANSFORM_HEAD = 120, 120  # bits that a code of distances and a transform are reckoned to take
TILE = 9  # bits of the encoder's predictor tiles
HASH = 0x1E35A7BD


class Bits:
    """Little-endian bits of a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)


# ---- prefix codes


_HALVES = np.arange(1 << 16, dtype=np.int64)
_REVERSED = np.zeros(1 << 16, np.int64)  # 16 bits in the opposite order
for _bit in range(16):
    _REVERSED |= (_HALVES >> _bit & 1) << (15 - _bit)


def words_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in the order of their words, code words as they lie in the stream) of canonical code lengths."""
    used = lengths.nonzero()[0]
    order = used[lengths[used].argsort(kind="stable")]
    n = lengths[order]
    spare = (int(n[-1]) if len(n) else 0) - n
    room = np.left_shift(1, spare)
    return order, _REVERSED[room.cumsum() - room >> spare] >> 16 - n


@cache
def _flip(bits: int) -> np.ndarray:
    """The numbers of so many bits in the opposite order."""
    return _REVERSED[: 1 << bits] >> 16 - bits


@dataclass
class Code:
    """A prefix code as a table over its longest word's bits; `only` if it has a single symbol."""

    lengths: np.ndarray
    only: int | None = None
    bits: int = 0
    symbol: np.ndarray = field(default=None, repr=False)
    length: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        used = self.lengths.nonzero()[0]
        if len(used) < 2:
            self.only = int(used[0]) if len(used) else 0
            return
        n = self.lengths[used]
        by_length = n.argsort(kind="stable")
        n = n[by_length]
        self.bits = int(n[-1])
        times = np.left_shift(1, self.bits - n)
        if int(times.sum()) != 1 << self.bits:
            raise ValueError("the code words don't fill their space")
        flip = _flip(self.bits)
        self.symbol = used[by_length].astype(np.int32).repeat(times).take(flip)
        self.length = n.astype(np.uint8).repeat(times).take(flip)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.read(self.bits)
        bits.at += int(self.length[at]) - self.bits
        return int(self.symbol[at])


@lru_cache(maxsize=256)
def _single(symbol: int, alphabet: int) -> Code:
    """The code of one symbol, which takes no bits."""
    lengths = np.zeros(alphabet, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


@cache
def _flips(bits: int) -> list[int]:
    return _flip(bits).tolist()


def _length_table(first: list[int]) -> tuple[list[int], list[int], int]:
    """(symbols, lengths, mask) of the code of the code lengths, as plain lists: it has 19 symbols."""
    order = sorted((s for s in range(19) if first[s]), key=first.__getitem__)
    if len(order) < 2:
        return order or [0], [0], 0
    bits = first[order[-1]]
    symbol, size = [], []
    for s in order:
        times = 1 << bits - first[s]
        symbol += [s] * times
        size += [first[s]] * times
    if len(symbol) != 1 << bits:
        raise ValueError("the code words don't fill their space")
    flip = _flips(bits)
    return [symbol[k] for k in flip], [size[k] for k in flip], (1 << bits) - 1


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbol = bits.read(8 if bits.read(1) else 1)
        if not two:
            return _single(symbol, alphabet)
        lengths = np.zeros(alphabet, np.int64)
        lengths[symbol] = 1
        lengths[bits.read(8)] = 1
        return Code(lengths)
    first = [0] * 19
    stored = 4 + bits.read(4)
    value = bits.read(3 * stored) if stored < 19 else bits.read(54) | bits.read(3) << 54
    for k in range(stored):
        first[CODE_LENGTH_ORDER[k]] = value >> 3 * k & 7
    symbol, size, mask = _length_table(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    data, start, pos = bits.data, bits.at, 0
    ahead = int.from_bytes(data[start >> 3 : (start >> 3) + 8], "little") >> (start & 7)
    out, previous = [], 8
    while len(out) < alphabet and left:
        left -= 1
        if pos > 40:  # a length takes at most 14 bits
            start += pos
            ahead, pos = int.from_bytes(data[start >> 3 : (start >> 3) + 8], "little") >> (start & 7), 0
        at = ahead >> pos & mask
        s = symbol[at]
        pos += size[at]
        if s < 16:
            out.append(s)
            previous = s or previous
        else:
            least, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
            out += [previous if s == 16 else 0] * (least + (ahead >> pos & (1 << extra) - 1))
            pos += extra
    if len(out) > alphabet:
        raise ValueError("code lengths run over")
    lengths = np.zeros(alphabet, np.int64)
    lengths[: len(out)] = out
    bits.at = start + pos
    return Code(lengths)


# ---- pixels


def _value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """The entropy-coded image as a flat array of ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_bits, which = 1, 0, None
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        which = (read_image(bits, -(-width >> group_bits), -(-height >> group_bits)) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, distance = codes[0]
    if groups == 1 and not cache_size and None not in (red.only, blue.only, alpha.only):
        copies = bool(green.lengths[256:].any())
        if not copies or green.only is None:
            samples = _tokens(bits, green, distance, total, width) if copies else _literals(bits, green, total)
            return np.uint32(alpha.only << 24 | red.only << 16 | blue.only) | samples.astype(np.uint32) << np.uint32(8)
    out: list[int] = []
    cache, cached = [0] * cache_size, 0
    across = -(-width >> group_bits)
    while len(out) < total:
        at = len(out)
        group = codes[which[(at // width >> group_bits) * across + (at % width >> group_bits)] if which else 0]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n, d = _value(bits, s - 256), _value(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            while cached < at:  # the cache is brought up to date only when it is asked
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


_EIGHT = np.arange(8, dtype=np.uint32)
# of each prefix symbol of a length or distance: how many bits follow, their mask, and the least number
_EXTRA = np.maximum(np.arange(40) - 2, 0) >> 1
_MASK = np.left_shift(1, _EXTRA) - 1
_LEAST = np.where(np.arange(40) < 4, np.arange(40), np.left_shift(2 + (np.arange(40) & 1), _EXTRA)) + 1


def _words(data: np.ndarray) -> np.ndarray:
    """The four bytes from each byte on as a number."""
    padded = np.zeros(len(data) + 3, np.uint32)
    padded[: len(data)] = data
    return padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)


def _chain(step: np.ndarray, at: int, n: int) -> np.ndarray:
    """The first n positions of the way that leads from each position to its step; fewer if it ends at the last position."""
    jumps, reach = [step], 1
    while reach < 8 and reach < n:
        jumps.append(jumps[-1].take(jumps[-1]))
        reach *= 2
    far, last, found = memoryview(jumps[-1]), len(step) - 1, []
    for _ in range(-(-n // reach)):
        found.append(at)
        if at == last:
            break
        at = far[at]
    chain = np.array(found, np.int64)
    for jump in reversed(jumps[:-1]):
        both = np.empty(2 * len(chain), np.int64)
        both[::2] = chain
        both[1::2] = jump.take(chain)
        chain = both
    return chain[:n]


def _literals(bits: Bits, code: Code, n: int) -> np.ndarray:
    """n symbols of one code, found at once."""
    if code.only is not None:
        return np.full(n, code.only, np.int32)
    start = bits.at >> 3
    word = _words(np.frombuffer(bits.data, np.uint8)[start : start + (n * code.bits + 7 >> 3) + 2])
    window = (word[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << code.bits) - 1)).ravel()
    step = np.minimum(np.arange(len(window)) + code.length[window], len(window) - 1)
    chain = _chain(step, bits.at & 7, n)
    if len(chain) < n:
        raise ValueError("the stream ends within the image")
    bits.at = start * 8 + int(step[chain[-1]])
    return code.symbol[window[chain]]


@cache
def _short(width: int) -> np.ndarray:
    """The distances of the short codes."""
    return np.array([max(1, x + y * width) for x, y in NEAR])


def _tokens(bits: Bits, green: Code, distance: Code, total: int, width: int) -> np.ndarray:
    """The samples of a stream of literals and back-references in one channel."""
    start = bits.at >> 3
    word = _words(np.frombuffer(bits.data, np.uint8)[start:])
    window = (word[:, None] >> _EIGHT & np.uint32((1 << green.bits) - 1)).astype(np.intp).ravel()
    last = len(window) - 1
    symbol = green.symbol.take(window)
    step = np.arange(len(window))
    step += green.length.take(window)

    def ahead(at: np.ndarray, mask) -> np.ndarray:  # up to 25 bits
        return word.take(at >> 3, mode="clip").astype(np.int64) >> (at & 7) & mask

    def number(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _LEAST.take(prefix) + ahead(at, _MASK.take(prefix)), at + _EXTRA.take(prefix)

    refs = (symbol >= 256).nonzero()[0]
    n, at = number(symbol.take(refs).astype(np.int64) - 256, step.take(refs))
    if distance.only is None:
        look = ahead(at, (1 << distance.bits) - 1)
        prefix, at = distance.symbol.take(look).astype(np.int64), at + distance.length.take(look)
    else:
        prefix = np.full(len(refs), distance.only, np.int64)
    back, at = number(prefix, at)
    step[refs] = np.minimum(at, last)
    chain = _chain(np.minimum(step, last, out=step), bits.at & 7, total)
    kind = symbol.take(chain)
    copies = (kind >= 256).nonzero()[0]
    which = refs.searchsorted(chain.take(copies))
    sizes = np.ones(len(chain), np.int64)
    sizes[copies] = n.take(which)
    ends = sizes.cumsum()
    used = int(ends.searchsorted(total)) + 1
    if used > len(chain) or ends[used - 1] != total:
        raise ValueError("a back-reference or the stream leaves the image")
    bits.at = start * 8 + int(step[chain[used - 1]])
    copies = copies[: np.searchsorted(copies, used)]
    which = which[: len(copies)]
    back = np.where(back[which] > 120, back[which] - 120, _short(width)[np.minimum(back[which], 120) - 1])
    begins = ends[copies] - n[which]
    if (back > begins).any():
        raise ValueError("a back-reference leaves the image")
    plain = np.zeros(total, np.uint8)
    literal = kind[:used] < 256
    plain[ends[:used][literal] - 1] = kind[:used][literal]
    out = bytearray(plain.tobytes())
    for at, many, d in zip(begins.tolist(), n[which].tolist(), back.tolist()):
        piece = out[at - d : min(at, at - d + many)]
        out[at : at + many] = piece if d >= many else (piece * (many // d + 1))[:many]
    return np.frombuffer(out, np.uint8)


# ---- transforms


def _bytes(argb: np.ndarray) -> np.ndarray:
    """(..., 4) channels a, r, g, b as small integers."""
    return np.stack([argb >> np.uint32(k) & np.uint32(255) for k in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left, up, up_left, up_right) -> tuple[int, int, int, int]:
    """The predicted channels of a pixel from its neighbours' channels."""
    mean = lambda a, b: tuple((x + y) >> 1 for x, y in zip(a, b))
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    match mode:
        case 1:
            return left
        case 2:
            return up
        case 3:
            return up_right
        case 4:
            return up_left
        case 5:
            return mean(mean(left, up_right), up)
        case 6:
            return mean(left, up_left)
        case 7:
            return mean(left, up)
        case 8:
            return mean(up_left, up)
        case 9:
            return mean(up, up_right)
        case 10:
            return mean(mean(left, up_left), mean(up, up_right))
        case 11:
            to_left = sum(abs(u - c) for u, c in zip(up, up_left))
            to_up = sum(abs(x - c) for x, c in zip(left, up_left))
            return left if to_left < to_up else up
        case 12:
            return tuple(clamp(x + u - c) for x, u, c in zip(left, up, up_left))
        case 13:
            return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, up), up_left))
    return (255, 0, 0, 0)


def undo_predictor(argb: np.ndarray, modes: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    mode = int(modes[0] >> 8 & 15)
    if mode in (1, 2) and (modes >> np.uint32(8) & np.uint32(15) == mode).all():  # sums along rows or columns
        sums = _bytes(argb).reshape(height, width, 4)
        sums[0, 0, 0] += 255
        sums[0] = np.cumsum(sums[0], axis=0)
        sums[:, : width if mode == 2 else 1] = np.cumsum(sums[:, : width if mode == 2 else 1], axis=0)
        if mode == 1:
            sums[1:] = np.cumsum(sums[1:], axis=1)
        return _argb(sums.reshape(-1, 4))
    px = [tuple(p) for p in _bytes(argb).tolist()]
    across = -(-width >> tile)
    kinds = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                guess = px[at - 1] if x else (255, 0, 0, 0)
            elif x == 0:
                guess = px[at - width]
            else:
                mode = kinds[(y >> tile) * across + (x >> tile)]
                guess = predict(mode, px[at - 1], px[at - width], px[at - width - 1], px[at - width + 1])
            px[at] = tuple((r + g) & 255 for r, g in zip(px[at], guess))
    return _argb(np.array(px, np.int32).reshape(-1, 4))


def undo_cross_colour(argb: np.ndarray, elements: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    e = _bytes(elements[(y >> tile) * -(-width >> tile) + (x >> tile)]).astype(np.int8).astype(np.int32)
    c = _bytes(argb)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (e[:, 3] * green >> 5)) & 255
    c[:, 3] = (c[:, 3] + (e[:, 2] * green >> 5) + (e[:, 1] * signed(c[:, 1]) >> 5)) & 255
    return _argb(c)


def undo_palette(argb: np.ndarray, colours: np.ndarray, width_bits: int, packed_width: int, width: int, height: int) -> np.ndarray:
    index = (argb >> np.uint32(8) & np.uint32(255)).reshape(height, packed_width)
    if width_bits:
        depth = 8 >> width_bits
        shifts = np.arange(1 << width_bits, dtype=np.uint32) * np.uint32(depth)
        index = (index[:, :, None] >> shifts & np.uint32((1 << depth) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index].ravel()


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, flat ARGB) of a WebP file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            sub = read_image(bits, -(-inner >> tile), -(-height >> tile))
            call = undo_predictor if kind == PREDICTOR else undo_cross_colour
            undo.append(lambda p, call=call, sub=sub, tile=tile, w=inner: call(p, sub, tile, w, height))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _argb(_bytes(p) + _bytes(p)[:, 2:3] * np.array([0, 1, 0, 1])))
        else:
            size = bits.read(8) + 1
            colours = _argb(np.cumsum(_bytes(read_image(bits, size, 1)), axis=0))
            width_bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            outer, inner = inner, -(-inner >> width_bits)
            undo.append(lambda p, c=colours, wb=width_bits, i=inner, o=outer: undo_palette(p, c, wb, i, o, height))
    pixels = read_image(bits, inner, height, main=True)
    for step in reversed(undo):
        pixels = step(pixels)
    return width, height, pixels


# ---- encoder of grey samples


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths, none over `longest`; rare symbols are rounded up until they fit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights, step = counts[used].astype(np.int64), longest
    while True:
        # leaves by weight, sums as they are made: the lightest two stand first in either row, leaves before sums of equal weight
        n, order = len(used), weights.argsort(kind="stable").tolist()
        light = [*weights[order].tolist(), 1 << 62, 1 << 62]
        sums, parent, leaf, inner = [], [0] * (2 * n - 1), 0, 0
        for made in range(n - 1):
            total = 0
            for _ in (0, 1):
                if inner == made or light[leaf] <= sums[inner]:
                    total += light[leaf]
                    parent[leaf] = n + made
                    leaf += 1
                else:
                    total += sums[inner]
                    parent[n + inner] = n + made
                    inner += 1
            sums.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= longest:
            out[used[order]] = depth[:n]
            return out
        step -= 1  # each round the rarest count for twice as much; at last all are equal
        weights = np.maximum(weights, (int(counts.sum()) >> max(step, 0)) + 1)


class Writer:
    """Bits in the order in which they are read."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(1, 1)
        for s in used.tolist() or [0]:
            out.put(s, 8)
        return
    tokens, at = [], 0
    for s, length in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), None]):
        while at < s:
            n = min(138, s - at)
            tokens += [(18, n - 11, 7)] if n > 10 else [(17, n - 3, 3)] if n > 2 else [(0, 0, 0)] * n
            at += n
        if length:
            tokens.append((length, 0, 0))
        at += 1
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    words = dict(zip(*(x.tolist() for x in words_of(first))))
    size = first.tolist()
    stored = 19
    while stored > 4 and not size[CODE_LENGTH_ORDER[stored - 1]]:
        stored -= 1
    head = (stored - 4) << 1
    for k, s in enumerate(CODE_LENGTH_ORDER[:stored]):
        head |= size[s] << 5 + 3 * k
    out.put(head, 6 + 3 * stored)
    if single := len(words) == 1:
        size = [0] * 19
    value = at = 0
    for s, extra, n in tokens:
        value |= (words[s] | extra << size[s]) << at if not single else extra << at
        at += size[s] + n
    out.put(value, at)


def _one_symbol(out: Writer, *symbols: int) -> None:
    for only in symbols:
        write_code(out, np.bincount([only], minlength=256))


@cache
def _flat_codes(alpha: int) -> tuple[int, int]:
    """The codes of the channels that never change: red 0, blue 0, one alpha."""
    out = Writer()
    _one_symbol(out, 0, 0, alpha)
    return out.value, out.n


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbols, extra bits, how many) of lengths or distances from 1 on."""
    v = values - 1
    p = _LEAST.searchsorted(values, side="right") - 1
    return p, v & _MASK.take(p), _EXTRA.take(p)


def repeats(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of disjoint stretches that occurred before, from left to right.

    Each place is held against the last one with the same hash of its next SEEN samples;
    neighbours that lie equally far from theirs form one stretch.
    """
    none = np.zeros(0, np.int64)
    if len(samples) <= SEEN:
        return none, none, none
    key = np.ndarray(len(samples) - SEEN + 1, np.uint64, np.ascontiguousarray(samples), 0, (1,)).copy()
    order = key * np.uint64(0x9E3779B97F4A7C15)
    order &= ~np.uint64(0xFFFFFFFF)
    order |= np.arange(len(key), dtype=np.uint64)
    order.sort()
    order &= np.uint64(0xFFFFFFFF)
    order = order.view(np.int64)
    seen = key.take(order)
    same = (seen[1:] == seen[:-1]).nonzero()[0]
    if not len(same):
        return none, none, none
    distance = np.zeros(len(key) + 1, np.int64)
    later = order.take(same + 1)
    distance[later] = later - order.take(same)
    # a stretch ends where the distance changes; it reaches SEEN - 1 samples beyond its last place
    turn = (distance[1:] != distance[:-1]).nonzero()[0] + 1
    far = distance.take(turn)
    at = far.nonzero()[0]  # the first place has no distance, nor has the end
    begin, end, far = turn.take(at), turn.take(at + 1) + (SEEN - 1), far.take(at)
    begin[1:] = np.maximum(begin[1:], end[:-1])
    kept = (end - begin >= SEEN).nonzero()[0]  # so each has room for a length and a distance
    begin, end, far = begin.take(kept), end.take(kept), far.take(kept)
    if not len(kept) or int((end - begin).max()) <= LONGEST_COPY:
        return begin, end - begin, far
    parts = -(-(end - begin) // LONGEST_COPY)
    place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(begin, parts) + place * LONGEST_COPY
    n = np.minimum(np.repeat(end, parts) - start, LONGEST_COPY)
    enough = n > 1
    return start[enough], n[enough], np.repeat(far, parts)[enough]


def _bits_of(counts: np.ndarray) -> float:
    """What a code would take for symbols that occur so often, at least a bit each if there are several."""
    used = counts[counts > 0].astype(np.float64)
    if len(used) < 2:
        return 0.0
    each = np.log2(used.sum() / used)
    np.maximum(each, 1, out=each)
    each *= used
    return float(each.sum())


@cache
def _near(width: int) -> np.ndarray:
    """For each distance that has a short code its least code, else 0."""
    table = np.zeros(8 * width + 9, np.int64)
    for code, distance in reversed(list(enumerate(_short(width).tolist(), 1))):
        table[distance] = code
    return table


def _tokens_of(samples: np.ndarray, width: int) -> tuple[float, tuple]:
    """(bits at a guess, tokens) of the shorter of literals alone and literals with back-references."""
    counts = np.bincount(samples, minlength=280)
    plain = _bits_of(counts)
    start, n, far = repeats(samples)
    if len(start):
        level = np.zeros(len(samples) + 1, np.int8)
        level[start] += 1
        level[start + n] -= 1  # no two end at one place
        left = (level[:-1].cumsum(dtype=np.int8) == 0).nonzero()[0]
        near = _near(width)
        code = np.where(far < len(near), near.take(far, mode="clip"), 0)
        p, p_bits, p_size = _prefix(n)
        d, d_bits, d_size = _prefix(np.where(code, code, far + 120))
        mixed = np.bincount(samples.take(left), minlength=280)
        mixed[256:] += np.bincount(p, minlength=24)
        away = np.bincount(d, minlength=40)
        size = _bits_of(mixed) + _bits_of(away) + int((p_size + d_size).sum()) + COPY_HEAD
        if size < plain:
            return size, (mixed, away, left, (start, p, p_bits, p_size, d, d_bits, d_size))
    return plain, (counts, np.bincount([0], minlength=40), None, None)


def _write_image(head: Writer, samples: np.ndarray, tokens: tuple, alpha: int) -> bytes:
    """The bits of the head, the codes and the samples."""
    counts, away, left, copies = tokens
    lengths, reach = code_lengths(counts, LONGEST), code_lengths(away, LONGEST)
    write_code(head, lengths)
    head.put(*_flat_codes(alpha))
    write_code(head, reach)

    def coded(lengths):
        symbols, words = words_of(lengths)
        code, n = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
        if len(symbols) > 1:
            code[symbols], n[symbols] = words, lengths[symbols]
        return code, n

    code, n = coded(lengths)
    if copies is None:
        value, size = code.take(samples), n.take(samples)
    else:
        far_code, far_n = coded(reach)
        start, p, p_bits, p_size, d, d_bits, d_size = copies
        # a copy takes two entries, its length and its distance, in place of its first two samples
        taken = np.zeros(len(samples), bool)
        taken[left] = taken[start] = taken[start + 1] = True
        value, size = code.take(samples), n.take(samples)
        p_n, d_n = n.take(256 + p), far_n.take(d)
        value[start] = code.take(256 + p) | (p_bits << p_n).view(np.uint64)
        size[start] = p_n + p_size
        value[start + 1] = far_code.take(d) | (d_bits << d_n).view(np.uint64)
        size[start + 1] = d_n + d_size
        value, size = value[taken], size[taken]
    ends = size.cumsum()
    at = ends - size + head.n
    total = int(ends[-1]) + head.n
    words64 = value << (at & 31).view(np.uint64)
    cell = at >> 5
    # starts rise, so those of a 32-bit cell are neighbours; their bits don't overlap
    new = np.ones(len(cell), bool)
    np.not_equal(cell[1:], cell[:-1], out=new[1:])
    first = new.nonzero()[0]
    merged = np.bitwise_or.reduceat(words64, first)
    filled = cell.take(first)
    cells = np.zeros((total >> 5) + 2, np.uint64)
    cells[filled] = merged & np.uint64(0xFFFFFFFF)
    cells[filled + 1] |= merged >> np.uint64(32)
    raw = cells.astype("<u4").tobytes()[: total + 7 >> 3]
    lead = head.n + 7 >> 3
    return (int.from_bytes(raw[:lead], "little") | head.value).to_bytes(lead, "little") + raw[lead:]


def _predictor_head(out: Writer, mode: int, width: int, height: int) -> None:
    """One mode for all tiles of the largest size."""
    out.put(1 | PREDICTOR << 1, 3)
    out.put(TILE - 2, 3)
    out.put(0, 1)
    write_code(out, np.bincount([mode], minlength=280))
    _one_symbol(out, 0, 0, 0, 0)


def _palette_head(out: Writer, levels: np.ndarray) -> None:
    """The palette as an image of one row, each colour as its difference to the one before."""
    out.put(1 | PALETTE << 1, 3)
    out.put(len(levels) - 1, 8)
    out.put(0, 1)
    steps = np.diff(levels, prepend=0)
    lengths = code_lengths(np.bincount(steps, minlength=280), LONGEST)
    write_code(out, lengths)
    _one_symbol(out, 0, 0)
    write_code(out, np.bincount([0, 255] if len(levels) > 1 else [255], minlength=256))
    _one_symbol(out, 0)
    symbols, words = words_of(lengths)
    word = dict(zip(symbols.tolist(), words.tolist()))
    for k, s in enumerate(steps.tolist()):
        if len(symbols) > 1:
            out.put(word[s], int(lengths[s]))
        if len(levels) > 1:
            out.put(int(k == 0), 1)


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A WebP file whose green channel holds the samples (8-bit, a multiple of width)."""
    height = len(samples) // width
    if not 1 <= width <= MAX_SIDE or not 1 <= height <= MAX_SIDE or width * height != len(samples):
        raise ValueError("the samples don't fill an image of a valid size")
    best, tokens = _tokens_of(samples, width)
    chosen, transform = samples, None
    rows = samples.reshape(height, width)
    for mode in (1, 2):
        rest = samples.copy()
        if mode == 1:
            rest[1:] -= samples[:-1]
            rest[width::width] = samples[width::width] - samples[:-width:width]  # the first column has its upper neighbour alone
        else:
            rest[1:width] -= samples[: width - 1]  # the first row has its left neighbour alone
            rest[width:] -= samples[:-width]
        if _bits_of(np.bincount(rest, minlength=256)) + TRANSFORM_HEAD < best:
            size, other = _tokens_of(rest, width)
            if size + TRANSFORM_HEAD < best:
                best, tokens, chosen, transform = size + TRANSFORM_HEAD, other, rest, mode
    levels = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(levels) <= 16:
        width_bits = 3 if len(levels) <= 2 else 2 if len(levels) <= 4 else 1
        packed = np.zeros((height, -(-width >> width_bits) << width_bits), np.uint8)
        packed[:, :width] = np.searchsorted(levels, rows)
        shifts = np.arange(1 << width_bits) * (8 >> width_bits)
        packed = np.bitwise_or.reduce(packed.reshape(height, -1, 1 << width_bits) << shifts, axis=2).astype(np.uint8).ravel()
        size, other = _tokens_of(packed, len(packed) // height)
        size += TRANSFORM_HEAD + 8 * len(levels)
        if size < best:
            best, tokens, chosen, transform = size, other, packed, PALETTE
    head = Writer()
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(0, 4)  # alpha hint and version
    if transform == PALETTE:
        _palette_head(head, levels)
    elif transform:
        _predictor_head(head, transform, width, height)
    head.put(0, 3)  # no more transforms, no colour cache, one group
    chunk = b"\x2f" + _write_image(head, chosen, tokens, 0 if transform in (1, 2) else 255)
    pad = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + (12 + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + pad
