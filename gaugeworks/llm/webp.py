"""Lossless WebP (VP8L) on numpy: a full decoder and the encoders that the media column needs.

The format is the public WebP lossless bitstream specification (RFC 9649). Pixels are ARGB words.
The decoder knows prefix codes of both kinds, meta prefix images, back-references, the colour cache
and all four transforms. Streams of literals under one group of codes (what `store` writes) take a
vectorised way: the code length at every bit is looked up at once, jumps over 16 pixels are
composed from it, and only every 16th pixel is followed in sequence.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

#: Order in which code-length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Colour cache multiplier, opaque black, alphabet sizes beside green.
CACHE_MULTIPLIER, BLACK = 0x1E35A7BD, 0xFF000000
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Neighbours that the 120 short distance codes stand for, by rule: all within reach, nearest first.
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
MAX_BITS, MAX_SIDE = 15, 1 << 14
WIDTH, STRIP_BYTES = 16, 4 * 16 * MAX_SIDE


class WebPError(ValueError):
    """A stream that breaks the format."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most MAX_BITS; weights are flattened until they fit."""
    weights = np.asarray(weights, dtype=np.int64)
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    floor = 1
    while True:
        heap = [(max(int(weights[s]), floor), i, (int(s),)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth, serial = dict.fromkeys(map(int, used), 0), len(used)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, serial, x + y))
            serial += 1
        if max(depth.values()) <= MAX_BITS:
            out[list(depth)] = list(depth.values())
            return out
        floor *= 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, with bits reversed: as they lie in a stream read from its low bits."""
    codes, code = np.zeros(len(lengths), dtype=np.uint32), 0
    for n in range(1, MAX_BITS + 1):
        for s in np.flatnonzero(lengths == n):
            codes[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
        code <<= 1
    return codes


class Code:
    """A prefix code: for every 15 bits ahead the symbol and its length; length 0 for a single symbol."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        self.symbol = np.zeros(1 << MAX_BITS, dtype=np.uint16)
        self.length = np.zeros(1 << MAX_BITS, dtype=np.uint8)
        self.largest = int(used.max()) if len(used) else 0
        if len(used) == 1:
            self.symbol[:] = used[0]
            return
        if sum(1 << (MAX_BITS - int(lengths[s])) for s in used) != 1 << MAX_BITS:
            raise WebPError("prefix code is not complete")
        codes = canonical(lengths)
        for s in used:
            n = int(lengths[s])
            self.symbol[codes[s] :: 1 << n] = s
            self.length[codes[s] :: 1 << n] = n


@lru_cache(maxsize=64)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, dtype=np.uint8))


class Reader:
    """Bits from the low end of each byte."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + ((n + 15) >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebPError("stream ends early")
        return v

    def symbol(self, code: Code) -> int:
        v = self.peek(MAX_BITS)
        self.at += int(code.length[v])
        if self.at > self.end:
            raise WebPError("stream ends early")
        return int(code.symbol[v])


def _read_code(r: Reader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, dtype=np.uint8)
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        symbols = [r.bits(8 if wide else 1)] + ([r.bits(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebPError("symbol outside its alphabet")
        lengths[symbols] = 1
        return _code(lengths.tobytes())
    inner = np.zeros(19, dtype=np.uint8)
    for k in range(4 + r.bits(4)):
        inner[CODE_LENGTH_ORDER[k]] = r.bits(3)
    inner_code = _code(inner.tobytes())
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = r.symbol(inner_code)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        value, n = (last, 3 + r.bits(2)) if s == 16 else (0, 3 + r.bits(3)) if s == 17 else (0, 11 + r.bits(7))
        if at + n > alphabet:
            raise WebPError("code lengths run over")
        lengths[at : at + n] = value
        at += n
    return _code(lengths.tobytes())


#: Groups of codes read lately: alphabet sizes to (bits, number of bits, codes), newest first.
_GROUPS: dict[tuple[int, ...], list[tuple[int, int, list[Code]]]] = {}


def _read_group(r: Reader, sizes: tuple[int, ...]) -> list[Code]:
    """The five codes of a group. Equal bits mean equal codes, so a group read before is known again."""
    lately = _GROUPS.setdefault(sizes, [])
    for value, n, codes in lately:
        if r.at + n <= r.end and r.peek(n) == value:
            r.at += n
            return codes
    start = r.at
    codes = [_read_code(r, n) for n in sizes]
    n, r.at = r.at - start, start
    lately.insert(0, (r.bits(n), n, codes))
    del lately[4:]
    return codes


# ---------------------------------------------------------------- decoding


def _long_value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image: cache, meta prefix image (main image only), codes, pixels."""
    total = width * height
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache is too large")
    groups_of, block = None, 0
    if main and r.bits(1):
        block = r.bits(3) + 2
        tiles = -(-width >> block)
        groups_of = (_read_pixels(r, tiles, -(-height >> block), False) >> 8 & 0xFFFF).reshape(-1, tiles)
    n_groups = int(groups_of.max()) + 1 if groups_of is not None else 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    groups = [_read_group(r, sizes) for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits and groups[0][0].largest < LITERALS and total >= 64:
        return _literals(r, groups[0], total)
    out, at = np.zeros(total, dtype=np.uint32), 0
    cache = np.zeros(1 << cache_bits, dtype=np.uint32) if cache_bits else None
    shift, cached = 32 - cache_bits, 0
    while at < total:
        green, red, blue, alpha, far = groups[int(groups_of[at // width >> block, at % width >> block]) if groups_of is not None else 0]
        s = r.symbol(green)
        if s < LITERALS:
            rd = r.symbol(red)
            bl = r.symbol(blue)
            out[at] = r.symbol(alpha) << 24 | rd << 16 | s << 8 | bl
            at += 1
        elif s < LITERALS + LENGTH_CODES:
            n = _long_value(r, s - LITERALS)
            d = _long_value(r, r.symbol(far))
            if d <= len(NEIGHBOURS):
                x, y = NEIGHBOURS[d - 1]
                d = max(1, x + y * width)
            else:
                d -= len(NEIGHBOURS)
            if d > at or at + n > total:
                raise WebPError("back-reference outside the image")
            out[at : at + n] = out[at - d : at - d + n] if d >= n else np.resize(out[at - d : at], n)
            at += n
        else:
            for p in out[cached:at].tolist():
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
            cached = at
            out[at] = cache[s - LITERALS - LENGTH_CODES]
            at += 1
    return out


def _literals(r: Reader, codes: list[Code], total: int) -> np.ndarray:
    """All pixels of a stream without back-references and cache, vectorised over its bits."""
    first = r.at >> 3
    data = np.frombuffer(r.data, dtype=np.uint8)[first:]
    wide = np.zeros(len(data) + 2, dtype=np.uint32)
    wide[: len(data)] = data
    words = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    ahead = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & ((1 << MAX_BITS) - 1)).ravel()
    n = len(ahead)
    here = np.arange(n + 1, dtype=np.int32)
    step = {}
    for c in codes[:4]:
        if id(c) not in step:
            jump = here.copy()
            jump[:n] += c.length[ahead]
            step[id(c)] = np.minimum(jump, n)
    green, red, blue, alpha = (step[id(c)] for c in codes[:4])
    if green is red is blue is alpha:
        two = green[green]
        pixel = two[two]
    else:
        pixel = alpha[blue[red[green]]]
    strides = [pixel]
    for _ in range(4):
        strides.append(strides[-1][strides[-1]])
    leap, at, marks = strides[4], r.at - 8 * first, []
    for _ in range(-(-total // 16)):
        marks.append(at)
        at = int(leap[at])
    place = np.array(marks, dtype=np.int32)
    for s in reversed(strides[:4]):
        place = np.stack([place, s[place]], axis=1).ravel()
    place = place[:total]
    end = int(pixel[place[-1]])
    if end >= n and 8 * first + end > r.end:
        raise WebPError("stream ends early")
    ahead = np.append(ahead, 0)
    out = []
    for c, s in zip(codes[:4], (green, red, blue, alpha), strict=True):
        out.append(c.symbol[ahead[place]].astype(np.uint32))
        place = s[place]
    r.at = 8 * first + end
    return out[3] << 24 | out[1] << 16 | out[0] << 8 | out[2]


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _average(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted pixel from the neighbours left, top, top right and top left."""
    if mode in (0, 14, 15):
        return BLACK
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    trio = list(zip(_channels(left), _channels(top), _channels(corner), strict=True))
    if mode == 11:
        toward_left = sum(abs(t - c) for _, t, c in trio)
        toward_top = sum(abs(a - c) for a, _, c in trio)
        return left if toward_left < toward_top else top
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 12:
        parts = [clamp(a + t - c) for a, t, c in trio]
    else:
        parts = []
        for mean, c in zip(_channels(_average(left, top)), _channels(corner), strict=True):
            d = mean - c
            parts.append(clamp(mean + (d // 2 if d >= 0 else -(-d // 2))))
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _with_prediction(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Add (undo) or take off each pixel's prediction from the true pixels around it."""
    tiles = -(-width >> bits)
    given, true = pixels.tolist(), pixels.tolist()
    out = [0] * len(given)
    known = out if undo else true
    for i, p in enumerate(given):
        x, y = i % width, i // width
        if not y:
            guess = known[i - 1] if x else BLACK
        elif not x:
            guess = known[i - width]
        else:
            guess = _predict(int(modes[(y >> bits) * tiles + (x >> bits)]), known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = _add(p, guess) if undo else _subtract(p, guess)
    return np.array(out, dtype=np.uint32)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _with_cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    tiles, i = -(-width >> bits), np.arange(len(pixels))
    e = elements[(i // width >> bits) * tiles + (i % width >> bits)]
    delta = lambda t, c: (_signed(t & 255) * _signed(c & 255)) >> 5
    green, red, blue = pixels >> 8 & 255, (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    sign = 1 if undo else -1
    new_red = (red + sign * delta(e, green)) & 255
    source_red = new_red if undo else red
    new_blue = (blue + sign * (delta(e >> 8, green) + delta(e >> 16, source_red))) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def _with_green(pixels: np.ndarray, undo: bool) -> np.ndarray:
    green = pixels >> 8 & 255
    move = green | green << 16
    low = (pixels & 0x00FF00FF) + move if undo else (pixels | np.uint32(0xFF00FF00)) - move
    return pixels & np.uint32(0xFF00FF00) | low & np.uint32(0x00FF00FF)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    """A VP8L payload to its pixels, height by width of ARGB words."""
    r = Reader(data)
    if r.bits(8) != 0x2F:
        raise WebPError("not a lossless stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise WebPError("unknown version")
    return decode_stream(r, width, height)


def decode_stream(r: Reader, width: int, height: int) -> np.ndarray:
    """Transforms and pixels of an image whose size is known: a stream without the header."""
    steps, packed, seen = [], width, set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            steps.append((kind, packed, bits, _read_pixels(r, -(-packed >> bits), -(-height >> bits), False)))
        elif kind == SUBTRACT_GREEN:
            steps.append((kind, packed, 0, None))
        else:
            n = r.bits(8) + 1
            colours = _read_pixels(r, n, 1, False).view(np.uint8).reshape(-1, 4).cumsum(axis=0, dtype=np.uint8).view(np.uint32).ravel()
            steps.append((kind, packed, _bundle_bits(n), colours))
            packed = -(-packed >> _bundle_bits(n))
    pixels = _read_pixels(r, packed, height, True)
    for kind, w, bits, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = _with_prediction(pixels, w, extra >> 8 & 15, bits, True)
        elif kind == CROSS_COLOUR:
            pixels = _with_cross_colour(pixels, w, extra, bits, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _with_green(pixels, True)
        else:
            x = np.arange(w)
            index = pixels.reshape(height, -1)[:, x >> bits] >> 8 & 255
            index = index >> ((x & (1 << bits) - 1) << (3 - bits)).astype(np.uint32) & ((1 << (8 >> bits)) - 1)
            pixels = np.append(extra, np.zeros(256, dtype=np.uint32))[index].ravel()
    return pixels.reshape(height, width)


def files_of(blob: bytes) -> list[bytes]:
    """The VP8L payloads of one or more WebP files, one after another."""
    out, at = [], 0
    while at < len(blob):
        if blob[at : at + 4] != b"RIFF" or blob[at + 8 : at + 16] != b"WEBPVP8L":
            raise WebPError("not a lossless WebP file")
        whole, size = struct.unpack_from("<I", blob, at + 4)[0], struct.unpack_from("<I", blob, at + 16)[0]
        if at + 8 + whole > len(blob) or size + 12 > whole:
            raise WebPError("file ends early")
        out.append(blob[at + 20 : at + 20 + size])
        at += 8 + whole
    return out


# ---------------------------------------------------------------- encoding


class Writer:
    """Bits into the low end of each byte; `symbols` appends many codes at once."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def bits(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def code(self, lengths: np.ndarray) -> None:
        """Store code lengths in the normal form, zero runs shortened; one symbol in the simple form."""
        used = np.flatnonzero(lengths)
        if len(used) <= 1 and (not len(used) or used[0] < 256):
            self.bits(1, 1), self.bits(0, 1), self.bits(1, 1), self.bits(int(used[0]) if len(used) else 0, 8)
            return
        items, at = [], 0
        while at < len(lengths):
            run = 1
            while at + run < len(lengths) and lengths[at + run] == lengths[at]:
                run += 1
            if lengths[at] == 0 and run >= 3:
                run = min(run, 138)
                items.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            else:
                run = 1
                items.append((int(lengths[at]), 0, 0))
            at += run
        inner = np.zeros(19, dtype=np.int64)
        for s, _, _ in items:
            inner[s] += 1
        if np.count_nonzero(inner) == 1:
            inner[(int(np.flatnonzero(inner)[0]) + 1) % 16] += 1
        inner_lengths = np.minimum(code_lengths(inner), 15)
        while inner_lengths.max() > 7:
            inner = np.where(inner > 0, inner // 2 + 1, 0)
            inner_lengths = code_lengths(inner)
        codes = canonical(inner_lengths)
        self.bits(0, 1), self.bits(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.bits(int(inner_lengths[s]), 3)
        self.bits(0, 1)
        for s, extra, n in items:
            self.bits(int(codes[s]), int(inner_lengths[s])), self.bits(extra, n)

    def finish(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _pack(codes: np.ndarray, lengths: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """Bytes of many codes that start at bit `at` (0-7) of the first byte, and the bit after them.
    Codes share no bits, so adding them up byte by byte puts them together."""
    ends = np.cumsum(lengths, dtype=np.int64) + at
    starts = ends - lengths
    total = np.bincount(starts >> 3, weights=codes << (starts & 7).astype(np.uint32), minlength=(int(ends[-1]) >> 3) + 3).astype(np.uint32)
    out = total & 255
    out[1:] += total[:-1] >> 8 & 255
    out[2:] += total[:-2] >> 16 & 255
    return out.astype(np.uint8), int(ends[-1])


@lru_cache(maxsize=1)
def text_code() -> np.ndarray:
    """Code lengths for bytes of prose by a rule: spaces, letters by rank in common prose, the rest rare."""
    weights = np.full(256, 2, dtype=np.int64)
    weights[32], weights[10], weights[0] = 9000, 400, 300
    for rank, letter in enumerate(b"entiasrohldcumgpbfvwyqkzjx"):
        weights[letter] = 6500 // (1 + rank // 3) - 20 * rank
        weights[letter - 32] = 60
    weights[48:58], weights[[44, 46]] = 40, 400
    weights[[33, 35, 36, 37, 38, 42, 124]] = 60
    weights[195], weights[160:192] = 700, 60
    return code_lengths(weights)


@lru_cache(maxsize=1)
def _text_head() -> tuple[int, int]:
    w = Writer()
    w.bits(0, 3)
    w.code(np.append(text_code(), np.zeros(LENGTH_CODES, dtype=np.uint8)))
    for _ in range(3):
        w.code(text_code())
    w.code(np.zeros(DISTANCE_CODES, dtype=np.uint8))
    return w.value, w.n


#: From so many bytes on a strip gets codes of its own.
OWN_CODES_FROM = 1 << 16


def _riff(payload: bytes) -> bytes:
    pad = len(payload) % 2
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(payload) + pad, b"WEBP", b"VP8L", len(payload)) + payload + b"\0" * pad


@lru_cache(maxsize=1)
def _text_codes() -> tuple[np.ndarray, np.ndarray]:
    return canonical(text_code()), text_code().astype(np.int64)


def _strip(samples: np.ndarray) -> bytes:
    """RGBA samples, a multiple of 64, as one file of width 16, literals only."""
    stream = samples.reshape(-1, 4)[:, [1, 0, 2, 3]]
    height = len(stream) // WIDTH
    w = Writer()
    w.bits(0x2F, 8), w.bits(WIDTH - 1, 14), w.bits(height - 1, 14), w.bits(1, 1), w.bits(0, 3)
    if len(samples) < OWN_CODES_FROM:
        head, n = _text_head()
        w.bits(head, n)
        codes, lengths = (t[stream.ravel()] for t in _text_codes())
    else:
        w.bits(0, 3)
        own = [code_lengths(np.bincount(stream[:, k], minlength=256)) for k in range(4)]
        for k, lengths in enumerate(own):
            w.code(np.append(lengths, np.zeros(LENGTH_CODES, dtype=np.uint8)) if k == 0 else lengths)
        w.code(np.zeros(DISTANCE_CODES, dtype=np.uint8))
        codes = np.stack([canonical(x)[stream[:, k]] for k, x in enumerate(own)], axis=1).ravel()
        lengths = np.stack([np.where(np.count_nonzero(x) > 1, x, 0).astype(np.int64)[stream[:, k]] for k, x in enumerate(own)], axis=1).ravel()
    head, at = w.finish(), w.n
    body, end = _pack(codes, lengths, at & 7)
    body = body[: (end + 7) // 8]
    if at & 7:
        first = bytes([head[-1] | int(body[0])]) if len(body) else head[-1:]
        return _riff(head[:-1] + first + body[1:].tobytes())
    return _riff(head + body.tobytes())


#: From so many of a hundred bits saved on, a strip is written with tools in place of plain literals.
WORTH_IT = 90
#: Share of samples close to their neighbour, or to the green one, from which predictors, or cross-colour, are tried.
ALIKE = 0.3


def _entropy(counts: np.ndarray) -> float:
    """Bits that symbols of these counts take at least."""
    counts = counts[counts > 0].astype(np.float64)
    return float(counts.sum() * np.log2(counts.sum()) - (counts * np.log2(counts)).sum())


def _cost(pixels: np.ndarray) -> float:
    """Bits of the four channels of pixels in codes of their own, and of these codes."""
    samples = np.ascontiguousarray(pixels).view(np.uint8).reshape(-1, 4)
    counts = [np.bincount(samples[:, k], minlength=256) for k in range(4)]
    return sum(_entropy(c) + 80 + 4 * np.count_nonzero(c) for c in counts)


def choose(pixels: np.ndarray, literal_bits: float) -> dict | None:
    """The tools that a strip (its pixels in order, WIDTH a row) is written with, or None for plain
    literals: those of least estimated size, if it is clearly below literal_bits.

    Back-references and the cache pay where runs of three pixels come back, a palette where there are
    few colours, predictors, cross-colour and subtracted green where neighbours or channels are alike.
    """
    n = len(pixels)
    if n < 2 * WIDTH:
        return None
    kinds, counts = np.unique(pixels, return_counts=True)
    wide = pixels.astype(np.uint64)
    runs = np.unique((wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1]) * np.uint64(0x2545F4914F6CDD1D) ^ wide[2:])
    fresh, plain = len(runs) / (n - 2), _cost(pixels)
    found = [({}, plain)]
    flat = np.ascontiguousarray(pixels).view(np.uint8)
    channels = flat.reshape(-1, 4)
    near = lambda a, b: float((a - b + np.uint8(2) < 5).mean())  # noqa: E731  how many samples are within two of others
    if near(flat[4:], flat[:-4]) >= ALIKE or near(flat[4 * WIDTH :], flat[: -4 * WIDTH]) >= ALIKE:
        left, top = (np.append(np.zeros(k, dtype=np.uint32), pixels[:-k]) for k in (1, WIDTH))
        apart = lambda other: (pixels | np.uint32(0x00FF00FF)) - (other & np.uint32(0xFF00FF00)) & np.uint32(0xFF00FF00) | (pixels | np.uint32(0xFF00FF00)) - (other & np.uint32(0x00FF00FF)) & np.uint32(0x00FF00FF)
        found += [({"predictor": 1}, _cost(apart(left)) + 200), ({"predictor": 2}, _cost(apart(top)) + 200)]
    if near(channels[:, [0, 2]], channels[:, [1]]) >= ALIKE:
        crossed = _with_cross_colour(pixels, WIDTH, np.full(-(-(n // WIDTH) >> 4), 0x202020, dtype=np.uint32), 4, False)
        found += [({"subtract_green": True}, _cost(_with_green(pixels, False)) + 3), ({"cross": 0x202020}, _cost(crossed) + 200)]
    if fresh < 0.7:
        found += [({"back_references": True, "cache_bits": 6}, (fresh + 0.02) * plain + 400)]
    if len(kinds) <= 256:
        by_index = _entropy(counts) + 26 * len(kinds) + 300
        found += [({"palette": True}, by_index), ({"palette": True, "back_references": True}, (fresh + 0.02) * _entropy(counts) + 26 * len(kinds) + 500)]
    tools, cost = min(found, key=lambda x: x[1])
    return tools if tools and cost * 100 < literal_bits * WORTH_IT else None


def _literal_bits(samples: np.ndarray) -> float:
    """Bits of a strip's plain literals."""
    if len(samples) < OWN_CODES_FROM:
        return float(_text_codes()[1][samples].sum()) + _text_head()[1]
    return _cost(samples)


def store(payload: bytes) -> bytes:
    """Any payload of a positive multiple of 64 bytes as WebP: strips of 16 pixels a row and at most
    16384 rows, each a file of its own, with the tools that choose names or as plain literals."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    samples = np.frombuffer(payload, dtype=np.uint8)
    out = []
    for k in range(0, len(samples), STRIP_BYTES):
        strip = samples[k : k + STRIP_BYTES]
        four = strip.reshape(-1, 4).astype(np.uint32)
        pixels = four[:, 3] << 24 | four[:, 0] << 16 | four[:, 1] << 8 | four[:, 2]
        tools = choose(pixels, _literal_bits(strip))
        out.append(_strip(strip) if tools is None else encode(pixels.reshape(-1, WIDTH), **tools))
    return b"".join(out)


def load(blob: bytes) -> list[np.ndarray]:
    """The pixel arrays of stored strips."""
    return [decode_vp8l(x) for x in files_of(blob)]


def samples_of(images: list[np.ndarray]) -> bytes:
    """RGBA samples in order: what `store` was given."""
    return b"".join(np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24], axis=-1).astype(np.uint8).tobytes() for p in images)


def encode(pixels: np.ndarray, *, predictor: int | None = None, cross: int | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, back_references: bool = False) -> bytes:
    """A general, plain encoder for images (height by width ARGB words) with the named tools.

    predictor: the mode of every block; cross: the colour element of every block. Palettes need 256
    colours at most.
    """
    height, width = pixels.shape
    flat = pixels.astype(np.uint32).ravel()
    w = Writer()
    w.bits(0x2F, 8), w.bits(width - 1, 14), w.bits(height - 1, 14), w.bits(1, 1), w.bits(0, 3)
    packed = width
    if palette:
        colours, index = np.unique(flat, return_inverse=True)
        bits = _bundle_bits(len(colours))
        w.bits(1, 1), w.bits(PALETTE, 2), w.bits(len(colours) - 1, 8)
        deltas = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), dtype=np.uint8))
        _write_pixels(w, np.ascontiguousarray(deltas).view(np.uint32).ravel(), len(colours), False, 0, False)
        packed = -(-width >> bits)
        rows = np.zeros((height, packed), dtype=np.uint32)
        for x in range(width):
            rows[:, x >> bits] |= index.reshape(height, width)[:, x].astype(np.uint32) << ((x & (1 << bits) - 1) << (3 - bits))
        flat = (rows << 8 | np.uint32(BLACK)).ravel()
    if predictor is not None:
        n = -(-packed >> 4) * -(-height >> 4)
        w.bits(1, 1), w.bits(PREDICTOR, 2), w.bits(2, 3)
        _write_pixels(w, np.full(n, BLACK | predictor << 8, dtype=np.uint32), -(-packed >> 4), False, 0, False)
        flat = _with_prediction(flat, packed, np.full(n, predictor), 4, False)
    if cross is not None:
        n = -(-packed >> 4) * -(-height >> 4)
        w.bits(1, 1), w.bits(CROSS_COLOUR, 2), w.bits(2, 3)
        elements = np.full(n, BLACK | cross, dtype=np.uint32)
        _write_pixels(w, elements, -(-packed >> 4), False, 0, False)
        flat = _with_cross_colour(flat, packed, elements, 4, False)
    if subtract_green:
        w.bits(1, 1), w.bits(SUBTRACT_GREEN, 2)
        flat = _with_green(flat, False)
    w.bits(0, 1)
    _write_pixels(w, flat, packed, True, cache_bits, back_references)
    return _riff(w.finish())


def _prefix_of(v: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    extra = (v - 1).bit_length() - 2
    top = (v - 1) >> extra
    return 2 * extra + top, (v - 1) & ((1 << extra) - 1), extra


def _write_pixels(w: Writer, flat: np.ndarray, width: int, main: bool, cache_bits: int, back_references: bool) -> None:
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    pixels, items, at, recent, cache = flat.tolist(), [], 0, {}, {}
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}

    def remember(lo: int, hi: int) -> None:
        for k in range(lo, hi):
            if k + 2 < len(pixels):
                recent[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]

    while at < len(pixels):
        start = recent.get(tuple(pixels[at : at + 3])) if back_references else None
        n = 0
        if start is not None:
            while at + n < len(pixels) and n < 4096 and pixels[start + n] == pixels[at + n]:
                n += 1
        key = (CACHE_MULTIPLIER * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            d = at - start
            items.append(("copy", _prefix_of(n), _prefix_of(near.get(d, d + len(NEIGHBOURS)))))
        elif cache_bits and cache.get(key) == pixels[at]:
            n = 1
            items.append(("cache", key, None))
        else:
            n = 1
            items.append(("pixel", pixels[at], None))
        remember(at, at + n)
        at += n
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    counts = [np.zeros(n, dtype=np.int64) for n in sizes]
    for kind, a, b in items:
        if kind == "pixel":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                counts[k][v] += 1
        elif kind == "cache":
            counts[0][LITERALS + LENGTH_CODES + a] += 1
        else:
            counts[0][LITERALS + a[0]] += 1
            counts[4][b[0]] += 1
    if np.count_nonzero(counts[0]) == 1 and np.flatnonzero(counts[0])[0] >= 256:
        counts[0][0] += 1
    lengths = [code_lengths(c) for c in counts]
    codes = [canonical(x) for x in lengths]
    for x in lengths:
        w.code(x)
    put = lambda k, s: w.bits(int(codes[k][s]), int(lengths[k][s])) if np.count_nonzero(lengths[k]) > 1 else None
    for kind, a, b in items:
        if kind == "pixel":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                put(k, v)
        elif kind == "cache":
            put(0, LITERALS + LENGTH_CODES + a)
        else:
            put(0, LITERALS + a[0])
            w.bits(a[1], a[2])
            put(4, b[0])
            w.bits(b[1], b[2])
