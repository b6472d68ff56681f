import hashlib
import zlib

import numpy as np
import pytest

from vouchlake.llm import webp as W
from vouchlake.llm.media import decode_payload, encode_payload, payload_of, pixels, read, store

RNG = np.random.default_rng(12)


def test_grey_images_round_trip():
    for n, high in ((576, 1), (576, 2), (1728, 3), (4032, 255), (28800, 60), (576 * 40, 256)):
        samples = RNG.integers(0, high, n).astype(np.uint8) if high < 256 else (RNG.geometric(0.02, n) % 256).astype(np.uint8)
        width, height, argb = W.decode(W.encode_grey(samples, 576))
        assert (width, height) == (576, n // 576)
        assert (argb >> 8 & 255 == samples).all() and (argb >> 24 == 255).all() and not (argb & 0xFF00FF).any()


def test_steep_counts_keep_code_words_short():
    counts = np.zeros(256, np.int64)
    a, b = 1, 1
    for k in range(40):
        counts[k], a, b = a, b, a + b
    lengths = W.code_lengths(counts, W.LONGEST)
    assert lengths.max() <= W.LONGEST and (2.0 ** -lengths[lengths > 0]).sum() == 1


class Stream(W.Writer):
    """Writes images with any of the format's means; all code words of an alphabet are about equally long."""

    def codes(self, cache_bits):
        out = []
        for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40):
            longest = (n - 1).bit_length()
            lengths = np.full(n, longest)
            lengths[: (1 << longest) - n] = longest - 1
            W.write_code(self, lengths)
            out.append((dict(zip(*(x.tolist() for x in W.words_of(lengths)))), lengths))
        return out

    def symbol(self, code, s):
        self.put(code[0][s], int(code[1][s]))

    def value(self, code, v):
        """A length or distance by its prefix."""
        prefix = next(p for p in range(40) if self.span(p)[0] <= v < self.span(p)[0] + (1 << self.span(p)[1]))
        return prefix, v - self.span(prefix)[0], self.span(prefix)[1]

    @staticmethod
    def span(p):
        if p < 4:
            return p + 1, 0
        extra = (p - 2) >> 1
        return ((2 + (p & 1)) << extra) + 1, extra

    def image(self, argb, width, cache_bits=0, main=False, groups=None, copies=False):
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        bits = 2
        if main:
            self.put(int(groups is not None), 1)
            if groups is not None:
                self.put(0, 3)
                self.image([g << 8 for g in groups], -(-width >> bits))
        codes = [self.codes(cache_bits) for _ in range(max(groups) + 1 if groups else 1)]
        cache, at = {}, 0
        while at < len(argb):
            x, y = at % width, at // width
            code = codes[groups[(y >> bits) * -(-width >> bits) + (x >> bits)]] if groups else codes[0]
            n = 0
            if copies:
                for d in (1, width, width + 1, 130):
                    n = 0
                    while d <= at and at + n < len(argb) and argb[at + n] == argb[at + n - d] and n < 70:
                        n += 1
                    if n > 2:
                        break
            slot = (W.HASH * argb[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if copies and n > 2:
                p, extra, size = self.value(code, n)
                self.symbol(code[0], 256 + p)
                self.put(extra, size)
                near = [k for k, (dx, dy) in enumerate(W.NEAR) if max(1, dx + dy * width) == d]
                p, extra, size = self.value(code, near[0] + 1 if near else d + 120)
                self.symbol(code[4], p)
                self.put(extra, size)
            elif cache_bits and cache.get(slot) == argb[at]:
                self.symbol(code[0], 280 + slot)
                n = 1
            else:
                for k, shift in enumerate((8, 16, 0, 24)):
                    self.symbol(code[k], argb[at] >> shift & 255)
                n = 1
            for k in range(n):
                if cache_bits:
                    cache[(W.HASH * argb[at + k] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[at + k]
            at += n

    def file(self):
        chunk = b"\x2f" + self.value_bytes()
        pad = chunk + b"\0" * (len(chunk) & 1)
        return b"RIFF" + (12 + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + pad

    def value_bytes(self):
        return self.__dict__["value_int"].to_bytes((self.n + 7) >> 3, "little")

    def __init__(self, width, height):
        self.value_int = self.n = 0
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def put(self, value, n):
        self.value_int |= int(value) << self.n
        self.n += n


def picture(width, height, colours=0):
    if colours:
        table = RNG.integers(0, 1 << 32, colours, dtype=np.uint64)
        return [int(table[k]) for k in RNG.integers(0, colours, width * height)]
    base = RNG.integers(0, 1 << 32, width * height, dtype=np.uint64)
    base[width * height // 2 :] = base[: width * height - width * height // 2]
    return [int(x) for x in base]


@pytest.mark.parametrize(("cache_bits", "copies", "grouped"), [(0, False, False), (4, False, False), (0, True, False), (6, True, True), (11, True, False)])
def test_entropy_coding(cache_bits, copies, grouped):
    width, height = 19, 13
    argb = picture(width, height, colours=9) if copies else picture(width, height)
    out = Stream(width, height)
    out.put(0, 1)
    groups = [k % 3 for k in range(-(-width >> 2) * -(-height >> 2))] if grouped else None
    out.image(argb, width, cache_bits, main=True, groups=groups, copies=copies)
    assert W.decode(out.file())[2].tolist() == argb


def minus(p, q):
    return sum(((p >> s) - (q >> s) & 255) << s for s in (0, 8, 16, 24))


def channels(p):
    return tuple(p >> s & 255 for s in (24, 16, 8, 0))


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 9, 7
    argb = picture(width, height)
    rest = []
    for at, p in enumerate(argb):
        x, y = at % width, at // width
        if y == 0:
            guess = argb[at - 1] if x else 0xFF000000
        elif x == 0:
            guess = argb[at - width]
        else:
            g = W.predict(mode, *(channels(argb[at - d]) for d in (1, width, width + 1, width - 1)))
            guess = g[0] << 24 | g[1] << 16 | g[2] << 8 | g[3]
        rest.append(minus(p, guess))
    out = Stream(width, height)
    out.put(1, 1)
    out.put(W.PREDICTOR, 2)
    out.put(0, 3)
    out.image([mode << 8] * (-(-width >> 2) * -(-height >> 2)), -(-width >> 2))
    out.put(0, 1)
    out.image(rest, width, main=True)
    assert W.decode(out.file())[2].tolist() == argb


def test_cross_colour_and_subtract_green():
    width, height = 11, 6
    argb = picture(width, height)
    signed = lambda v: v - 256 if v > 127 else v
    to_red, to_blue, red_to_blue = 0xC1, 0x35, 0x9A
    rest = []
    for p in argb:
        a, r, g, b = channels(p)
        r2 = r - (signed(to_red) * signed(g) >> 5) & 255
        b2 = b - (signed(to_blue) * signed(g) >> 5) - (signed(red_to_blue) * signed(r) >> 5) & 255
        rest.append(a << 24 | (r2 - g & 255) << 16 | g << 8 | (b2 - g & 255))
    out = Stream(width, height)
    out.put(1, 1)
    out.put(W.CROSS_COLOUR, 2)
    out.put(0, 3)
    element = 255 << 24 | red_to_blue << 16 | to_blue << 8 | to_red
    out.image([element] * (-(-width >> 2) * -(-height >> 2)), -(-width >> 2))
    out.put(1, 1)
    out.put(W.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    out.image(rest, width, main=True)
    assert W.decode(out.file())[2].tolist() == argb


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes(colours):
    width, height = 13, 5
    table = [int(x) for x in RNG.integers(0, 1 << 32, colours, dtype=np.uint64)]
    index = RNG.integers(0, colours, width * height).tolist()
    out = Stream(width, height)
    out.put(1, 1)
    out.put(W.PALETTE, 2)
    out.put(colours - 1, 8)
    out.image([minus(c, table[k - 1]) if k else c for k, c in enumerate(table)], colours)
    out.put(0, 1)
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    packed = -(-width >> bits)
    depth = 8 >> bits
    cells = [0] * (packed * height)
    for k, i in enumerate(index):
        x, y = k % width, k // width
        cells[y * packed + (x >> bits)] |= i << (x % (1 << bits)) * depth
    out.image([c << 8 for c in cells], packed, main=True)
    assert W.decode(out.file())[2].tolist() == [table[i] for i in index]


def test_bad_files_are_refused():
    good = W.encode_grey(np.zeros(576, np.uint8), 576)
    for bad in (b"", b"RIFF", good.replace(b"VP8L", b"VP8X"), good[:20] + b"\0" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            W.decode(bad)


def test_texts_come_back(spark, sf_small, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf_small}/documents.parquet"), odd_docs):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        rows = read(store(docs)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
    stored = {r.doc_id: r.media for r in store(odd_docs).collect()}
    assert decode_payload(stored[6]).tobytes() == payload_of(texts[6]).tobytes() and stored[6].count(b"WEBPVP8L") > 1
    assert encode_payload(payload_of("x")) == encode_payload(payload_of("x"))
    assert read(store(no_docs)).count() == 0


class Plain:
    """A decoder of one-channel files that reads bit by bit and shares nothing with the library's but the fixed values."""

    def __init__(self, data):
        self.bits, self.at, self.kinds, self.copies = "".join(f"{b:08b}"[::-1] for b in data[21:]), 0, [], 0

    def take(self, n):
        word = self.bits[self.at : self.at + n]
        self.at += n
        return int(word[::-1] or "0", 2)

    def symbol(self, code):
        if len(code) == 1:
            return next(iter(code.values()))
        word = ""
        while word not in code:
            word += self.bits[self.at]
            self.at += 1
        return code[word]

    @staticmethod
    def canonical(lengths):
        code, word, before = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            word <<= n - before
            code[f"{word:0{n}b}"] = s
            word, before = word + 1, n
        return code

    def code(self, alphabet):
        if self.take(1):
            n, wide = self.take(1) + 1, self.take(1)
            symbols = [self.take(8 if wide else 1)] + [self.take(8) for _ in range(n - 1)]
            return self.canonical([int(s in symbols) for s in range(256)])
        first = [0] * 19
        for s in W.CODE_LENGTH_ORDER[: 4 + self.take(4)]:
            first[s] = self.take(3)
        first, lengths, before = self.canonical(first), [], 8
        assert not self.take(1)
        while len(lengths) < alphabet:
            s = self.symbol(first)
            if s < 16:
                lengths.append(s)
                before = s or before
            else:
                lengths += [before if s == 16 else 0] * {16: lambda: 3 + self.take(2), 17: lambda: 3 + self.take(3), 18: lambda: 11 + self.take(7)}[s]()
        return self.canonical(lengths)

    def number(self, prefix):
        extra = (prefix - 2) // 2
        return prefix + 1 if prefix < 4 else (2 + prefix % 2) * 2**extra + self.take(extra) + 1

    def image(self, width, height, main=False):
        assert not self.take(1 + main)
        green, red, blue, alpha, distance = (self.code(n) for n in (280, 256, 256, 256, 40))
        out = []
        while len(out) < width * height:
            s = self.symbol(green)
            if s < 256:
                out.append((s, self.symbol(red), self.symbol(blue), self.symbol(alpha)))
            else:
                self.copies += 1
                n, d = self.number(s - 256), self.number(self.symbol(distance))
                d = d - 120 if d > 120 else max(1, W.NEAR[d - 1][0] + W.NEAR[d - 1][1] * width)
                for _ in range(n):
                    out.append(out[-d])
        return out

    def samples(self):
        width, height = self.take(14) + 1, self.take(14) + 1
        self.take(4)
        mode = colours = None
        inner = width
        while self.take(1):
            self.kinds.append(self.take(2))
            if self.kinds[-1] == W.PREDICTOR:
                tile = 2 ** (self.take(3) + 2)
                (mode,) = {p[0] for p in self.image(-(-width // tile), -(-height // tile))}
            else:
                assert self.kinds[-1] == W.PALETTE
                colours = self.image(self.take(8) + 1, 1)
                for k in range(1, len(colours)):
                    colours[k] = tuple((a + b) % 256 for a, b in zip(colours[k - 1], colours[k]))
                per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
                inner = -(-width // per)
        out = self.image(inner, height, main=True)
        if colours:
            bits = 8 // per
            out = [colours[out[y * inner + x // per][0] >> x % per * bits & 2**bits - 1] for y in range(height) for x in range(width)]
        if mode:
            for at in range(len(out)):
                x, y = at % width, at // width
                left = y == 0 or (x > 0 and mode == 1)
                guess = (0, 0, 0, 255) if at == 0 else out[at - 1] if left else out[at - width]
                out[at] = tuple((a + b) % 256 for a, b in zip(out[at], guess))
        assert {p[1:] for p in out} == {(0, 0, 255)}
        return [p[0] for p in out]


def grey_cases():
    line = RNG.integers(0, 256, 576).astype(np.uint8)
    words = " ".join(("alpha", "beta", "gamma", "delta")[k] for k in RNG.integers(0, 4, 900)).encode()
    yield "noise", RNG.integers(0, 256, 576 * 3).astype(np.uint8), set(), False
    yield "text", payload_of(words.decode() + " " + words.decode()), None, True
    yield "ramp", (np.cumsum(RNG.integers(0, 3, 576 * 9)) % 256).astype(np.uint8), {W.PREDICTOR}, None
    yield "rows", np.cumsum([line, *RNG.integers(0, 2, (11, 576))], axis=0).astype(np.uint8).ravel(), {W.PREDICTOR}, None
    yield "cycle", np.tile(RNG.integers(0, 256, 700).astype(np.uint8), 576)[: 576 * 70], set(), True
    for levels in (2, 3, 4, 5):
        often = np.append(0.97, np.full(levels - 1, 0.03 / (levels - 1)))
        yield f"levels {levels}", RNG.choice(RNG.choice(256, levels, replace=False), 576 * 4, p=often).astype(np.uint8), {W.PALETTE}, None
    yield "two, repeated", np.tile(RNG.choice([3, 200], 600).astype(np.uint8), 96)[: 576 * 100], {W.PALETTE}, True
    yield "one level", np.full(1152, 255, np.uint8), None, None
    yield "short ways", np.concatenate([RNG.integers(0, 256, 640).astype(np.uint8)] * 9), set(), True


def test_encoder_takes_the_means_that_pay_and_others_can_read_it():
    for name, samples, kinds, copies in grey_cases():
        media = W.encode_grey(samples, 576)
        plain = Plain(media)
        assert plain.samples() == samples.tolist(), name
        assert kinds is None or set(plain.kinds) == kinds, (name, plain.kinds)
        assert copies is None or (plain.copies > 0) == copies, (name, plain.copies)
        width, height, argb = W.decode(media)
        assert (width, height) == (576, len(samples) // 576)
        assert (argb == (0xFF000000 | samples.astype(np.uint32) << 8)).all(), name


def test_stretches_that_occurred_before():
    for samples in (np.tile(np.arange(50, dtype=np.uint8), 300), RNG.integers(0, 3, 5000).astype(np.uint8), np.zeros(9000, np.uint8), np.zeros(5, np.uint8)):
        start, n, far = W.repeats(samples)
        assert (start[1:] >= (start + n)[:-1]).all() and (n <= W.LONGEST_COPY).all() and (n > 1).all()
        for s, m, d in zip(start.tolist(), n.tolist(), far.tolist()):
            assert d <= s and (samples[s : s + m] == samples[s - d : s + m - d]).all()
    assert W.repeats(np.zeros(9000, np.uint8))[1].sum() == 8999


def test_pixels_of_colour_images(spark):
    width, height = 19, 13
    argb = picture(width, height, colours=9)
    out = Stream(width, height)
    out.put(0, 1)
    out.image(argb, width, 6, main=True, copies=True)
    grey = W.encode_grey(np.arange(4, dtype=np.uint8), 2)
    rows = [(1, out.file() + grey), (None, grey), (2, None), (3, b"")]
    got = pixels(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((r.doc_id or 0, r.part, r.width, r.height) for r in got) == [(0, 0, 2, 2), (1, 0, 19, 13), (1, 1, 2, 2)]
    colour = next(r for r in got if r.width == 19)
    assert list(colour.rgba) == [p >> s & 255 for p in argb for s in (16, 8, 0, 24)]
    assert list(next(r for r in got if r.doc_id is None).rgba) == [x for g in range(4) for x in (0, g, 0, 255)]


def test_cut_streams_are_refused():
    good = W.encode_grey(payload_of(" ".join(f"word {k % 37} of many" for k in range(400))), 576)
    for at in (40, 120, len(good) // 2):
        with pytest.raises((ValueError, IndexError)):
            W.decode(good[:at])


def test_a_short_text_takes_few_calls():
    """Most texts are a few kB, so what a file costs is the number of calls, not the samples."""
    import sys

    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(2, 9, 300)]
    payload = payload_of(" ".join(words[min(int(k), 299)] for k in rng.geometric(0.02, 400)))
    assert (decode_payload(encode_payload(payload)) == payload).all()  # and what is made once is there
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        decode_payload(encode_payload(payload))
    finally:
        sys.setprofile(None)
    assert calls[0] < 1250  # 1486 when codes of one symbol were built anew and code lengths came from a heap


def test_code_lengths_are_those_of_a_heap():
    import heapq

    for k in range(300):
        counts = np.minimum(RNG.geometric(10.0 ** -RNG.uniform(0.1, 3), int(RNG.integers(2, 281))), 1 << 20)
        heap = [(int(w), s, (s,)) for s, w in enumerate(counts)]
        heapq.heapify(heap)
        lengths, made = np.zeros(len(counts), np.int64), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
            made += 1
        if lengths.max() <= 15:
            assert (W.code_lengths(counts, 15) == lengths).all(), k
