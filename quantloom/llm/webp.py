"""Lossless WebP (VP8L): a complete decoder and an encoder, both on numpy arrays.

The format is that of the public WebP lossless bitstream specification. Pixels are uint32 ARGB.

Decoding has two paths. A stream with one prefix-code group is decoded speculatively: for every bit
position of a window the token that would start there, and where the next one would start, are looked
up at once; then the real chain of positions is followed. Streams with several groups (entropy images)
are decoded token by token. Both give the same pixels.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
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
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 16384
MAX_CODE = 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: Bits whose possible tokens are looked up at once; bounds the decoder's memory.
WINDOW_BITS = 1 << 18
ALPHA = np.uint32(0xFF000000)


class WebPError(ValueError):
    """The bytes are not a valid lossless WebP image."""


def _reversal(bits: int) -> np.ndarray:
    """The number with the reversed `bits` bits of each number below 1 << bits."""
    n = np.arange(1 << bits)
    out = np.zeros_like(n)
    for bit in range(bits):
        out |= (n >> bit & 1) << (bits - 1 - bit)
    return out


REVERSAL = [_reversal(bits) for bits in range(MAX_CODE + 1)]


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in the order of their canonical codes, with their code lengths."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    return order, lengths[order]


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest, from the code lengths."""
    lengths = np.asarray(lengths, np.int64)
    codes = np.zeros(len(lengths), np.int64)
    order, sizes = _by_length(lengths)
    if len(order) > 1:
        spans = 1 << (MAX_CODE - sizes)  # a code of n bits takes 1 << 15 - n places of all 15-bit numbers
        codes[order] = REVERSAL[MAX_CODE][np.cumsum(spans) - spans]
    return codes


class PrefixCode:
    """A lookup table: the next `bits` bits of the stream give a symbol and the length of its code."""

    __slots__ = ("bits", "length", "symbol")

    def __init__(self, lengths: np.ndarray):
        order, sizes = _by_length(np.asarray(lengths, np.int64))
        if not len(order):
            raise WebPError("a prefix code has no symbol")
        if len(order) == 1:  # takes no bits in the stream
            self.bits, self.symbol, self.length = 0, order, np.zeros(1, np.int64)
            return
        self.bits = int(sizes[-1])
        spans = 1 << (self.bits - sizes)
        if int(spans.sum()) != 1 << self.bits:
            raise WebPError("a prefix code is not complete")
        turned = REVERSAL[self.bits]
        self.symbol, self.length = np.repeat(order, spans)[turned], np.repeat(sizes, spans)[turned]


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.n = data + bytes(16), 0, 8 * len(data)

    def peek(self, bits: int) -> int:
        start = self.at >> 3
        return int.from_bytes(self.data[start : start + 8], "little") >> (self.at & 7) & ((1 << bits) - 1)

    def peek_long(self, bits: int) -> int:
        word = self.data[self.at >> 3 : (self.at + bits + 7) >> 3]
        return int.from_bytes(word, "little") >> (self.at & 7) & ((1 << bits) - 1)

    def read(self, bits: int) -> int:
        value = self.peek(bits)
        self.at += bits
        if self.at > self.n:
            raise WebPError("the data ends early")
        return value

    def symbol(self, code: PrefixCode) -> int:
        if not code.bits:
            return int(code.symbol[0])
        at = self.peek(code.bits)
        self.at += int(code.length[at])
        if self.at > self.n:
            raise WebPError("the data ends early")
        return int(code.symbol[at])


def _read_code(bits: BitReader, size: int, known: dict) -> PrefixCode:
    """known: codes met before by their own bits, for codes that are repeated bit by bit."""
    start = bits.at
    for (own_bits, n), code in known.items():
        if bits.peek_long(n) == own_bits:
            bits.at += n
            return code
    code, whole = _parse_code(bits, size)
    if whole and (code.symbol < 256).all():  # nothing in it depends on the alphabet's size
        n = bits.at - start
        bits.at = start
        known[bits.peek_long(n), n] = code
        bits.at += n
    return code


def _parse_code(bits: BitReader, size: int) -> tuple[PrefixCode, bool]:
    """The code, and whether it states how many lengths it holds."""
    lengths, whole = np.zeros(size, np.int64), False
    if bits.read(1):
        two, first = bits.read(1), bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= size:
            raise WebPError("a symbol is out of range")
        lengths[symbols] = 1
    else:
        own = np.zeros(19, np.int64)
        for i in range(4 + bits.read(4)):
            own[CODE_LENGTH_ORDER[i]] = bits.read(3)
        whole = bool(bits.read(1))
        most = 2 + bits.read(2 + 2 * bits.read(3)) if whole else size
        code, before = PrefixCode(own), 8
        symbols, sizes = code.symbol.tolist(), code.length.tolist()
        mask, place, data = (1 << code.bits) - 1, bits.at, bits.data
        out: list[int] = []
        while len(out) < size and most:
            most -= 1
            word = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
            symbol = symbols[word & mask]
            place += (used := sizes[word & mask])
            if symbol < 16:
                out.append(symbol)
                before = symbol or before
            else:
                word >>= used
                extra, base = ((2, 3), (3, 3), (7, 11))[symbol - 16]
                out += [before if symbol == 16 else 0] * (base + (word & ((1 << extra) - 1)))
                place += extra
        bits.at = place
        if len(out) > size or place > bits.n:
            raise WebPError("the code lengths don't fit")
        lengths[: len(out)] = out
    return PrefixCode(lengths), whole


def _read_group(bits: BitReader, cache_bits: int, known: dict) -> list[PrefixCode]:
    return [_read_code(bits, size, known) for size in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def _prefix_value(symbol: int, bits: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = DISTANCE_MAP[code - 1]
    return max(1, dx + dy * width)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> int:
    if distance > at or at + length > len(out):
        raise WebPError("a back-reference leaves the image")
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)
    return at + length


def _cache_key(pixel, bits: int):
    return (np.asarray(pixel, np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def _read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; main: it may have a meta prefix image."""
    known: dict = {}
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    meta, step = None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        across, down = -(-width >> step), -(-height >> step)
        meta = (_read_pixels(bits, -(-width // (1 << step)), -(-height // (1 << step)), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        meta = meta.reshape(-(-height // (1 << step)), -(-width // (1 << step)))
    groups = [_read_group(bits, cache_bits, known) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    out = np.zeros(width * height, np.uint32)
    if len(groups) == 1:
        _fast_tokens(bits, groups[0], out, width, cache_bits)
    else:
        _slow_tokens(bits, groups, meta, step, out, width, cache_bits)
    return out


def _slow_tokens(bits: BitReader, groups: list, meta: np.ndarray | None, step: int, out: np.ndarray, width: int, cache_bits: int) -> None:
    cache, at, cached = np.zeros(1 << cache_bits, np.uint32), 0, 0

    def fill(upto: int) -> None:
        nonlocal cached
        cache[_cache_key(out[cached:upto], cache_bits)] = out[cached:upto]  # the last of equal keys stays
        cached = upto

    while at < len(out):
        y, x = divmod(at, width)
        green, red, blue, alpha, far = groups[int(meta[y >> step, x >> step]) if meta is not None else 0]
        token = bits.symbol(green)
        if token < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            out[at] = bits.symbol(alpha) << 24 | r << 16 | token << 8 | b
            at += 1
        elif token < 280:
            length = _prefix_value(token - 256, bits)
            at = _copy(out, at, _distance(_prefix_value(bits.symbol(far), bits), width), length)
        else:
            fill(at)
            out[at] = cache[token - 280]
            at += 1


def _fast_tokens(bits: BitReader, group: list[PrefixCode], out: np.ndarray, width: int, cache_bits: int) -> None:
    """Looks up the token at every bit of a window, then follows the chain of real ones."""
    green, red, blue, alpha, far = group
    if not any(x.bits for x in group[:4]) and green.symbol[0] < 256:
        out[:] = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0])
        return
    plain = int(green.symbol.max()) < 256
    if plain and green.bits and not alpha.bits and all(x is green or x.bits == green.bits and (x.symbol == green.symbol).all() for x in (red, blue)):
        return _one_code_tokens(bits, green, int(alpha.symbol[0]), out)
    if not plain and not green.bits:
        return _slow_tokens(bits, [group], None, 0, out, width, cache_bits)
    data = np.frombuffer(bits.data, np.uint8)
    masks = [(1 << x.bits) - 1 for x in group[:4]]
    done, cached, cache = 0, 0, [0] * (1 << cache_bits)

    def fill(upto: int) -> None:
        """Pixels that the cache hasn't seen yet, in order."""
        nonlocal cached
        for key, value in zip(_cache_key(out[cached:upto], cache_bits).tolist(), out[cached:upto].tolist(), strict=True):
            cache[key] = value
        cached = upto

    while done < len(out):
        start = bits.at
        span = min(WINDOW_BITS, bits.n - start)
        if span < 0:
            raise WebPError("the data ends early")
        words = _windows(bits, data, span)
        room = len(words)
        # every position: the lengths of the four codes one after the other
        here = np.arange(min(span + 1, room - 64))
        nxt = here
        parts = []
        for code, mask in zip(group[:4], masks, strict=True):
            if code.bits:
                key = words[nxt] & mask if nxt is not here else words[: len(here)] & mask
                parts.append(code.symbol[key])
                nxt = nxt + code.length[key]
            else:
                parts.append(int(code.symbol[0]))
        if not plain:  # other tokens end after their green symbol; the chain stops there
            tokens = parts[0]
            key = words[: len(here)] & masks[0]
            nxt = np.where(tokens < 256, nxt, np.where(tokens < 280, -1, here + green.length[key]))
        follow, place, limit = memoryview(nxt), 0, len(here) - 1
        if plain:
            chain = []
            append = chain.append
            for _ in range(len(out) - done):
                if place >= limit:
                    break
                append(place)
                place = follow[place]
            if start + place > bits.n or not chain:
                raise WebPError("the data ends early")
            at = np.array(chain)
            out[done : done + len(at)] = _argb(*(x[at] if isinstance(x, np.ndarray) else x for x in parts))
            done += len(at)
            bits.at = start + place
            continue
        moved = 0
        while place < limit and done < len(out):
            chain, to = [], 0
            append = chain.append
            for _ in range(len(out) - done):
                if place >= limit:
                    break
                to = follow[place]
                if to < 0:
                    break
                append(place)
                place = to
            if start + place > bits.n:
                raise WebPError("the data ends early")
            moved += len(chain)
            if chain:
                at = np.array(chain)
                token, *others = (x[at] if isinstance(x, np.ndarray) else np.full(len(at), x) for x in parts)
                pixels = _argb(token & 255, *others)
                if int(token.max()) >= 280:
                    fill(done)
                    keys = _cache_key(pixels, cache_bits).tolist()
                    own = []
                    for code, key, value in zip(token.tolist(), keys, pixels.tolist(), strict=True):
                        if code < 256:
                            cache[key] = value
                            own.append(value)
                        else:
                            own.append(cache[code - 280])
                    out[done : done + len(at)] = own
                    cached = done + len(at)
                else:
                    out[done : done + len(at)] = pixels
                done += len(at)
            bits.at = start + place
            if to < 0 and done < len(out):  # a back-reference, then on in the same window
                token = bits.symbol(green)
                length = _prefix_value(token - 256, bits)
                done = _copy(out, done, _distance(_prefix_value(bits.symbol(far), bits), width), length)
                place, moved = bits.at - start, moved + 1
        if not moved and done < len(out):
            raise WebPError("the data ends early")


def _argb(green, red, blue, alpha) -> np.ndarray:
    return np.asarray(alpha, np.uint32) << np.uint32(24) | np.asarray(red, np.uint32) << np.uint32(16) | np.asarray(green, np.uint32) << np.uint32(8) | np.asarray(blue, np.uint32)


def _windows(bits: BitReader, data: np.ndarray, span: int) -> np.ndarray:
    """The 24 bits that start at each of the next bits."""
    first = bits.at >> 3
    chunk = np.zeros(span // 8 + 20, np.int64)
    got = data[first : first + len(chunk)]
    chunk[: len(got)] = got
    triple = chunk[:-2] | chunk[1:-1] << 8 | chunk[2:] << 16
    return (triple[:, None] >> BIT).ravel()[bits.at & 7 :]


def _one_code_tokens(bits: BitReader, code: PrefixCode, alpha: int, out: np.ndarray) -> None:
    """Literals whose three colours have the same code: a chain of single symbols."""
    data = np.frombuffer(bits.data, np.uint8)
    flat, done, need = np.empty(3 * len(out), np.uint8), 0, 3 * len(out)
    while need:
        span = min(WINDOW_BITS, bits.n - bits.at)
        if span <= 0:
            raise WebPError("the data ends early")
        key = _windows(bits, data, span)[:span] & ((1 << code.bits) - 1)
        step = np.arange(span + MAX_CODE)  # places beyond the window lead to themselves
        step[:span] += code.length[key]
        jumps = [step]  # of 1, 2, 4 and 8 symbols
        for _ in range(3):
            jumps.append(jumps[-1][jumps[-1]])
        follow, place, heads = memoryview(jumps[-1]), 0, []
        append = heads.append
        for _ in range(-(-need // 8)):
            if place >= span:
                break
            append(place)
            place = follow[place]
        chain = np.array(heads)
        for jump in jumps[2::-1]:
            chain = np.stack([chain, jump[chain]], axis=1).ravel()
        chain = chain[: need + 1]
        inside = int(np.searchsorted(chain, span))
        place = int(chain[need]) if need < len(chain) and inside > need else place if inside >= len(chain) else int(chain[inside])
        chain = chain[: min(inside, need)]
        flat[done : done + len(chain)] = code.symbol[key[chain]]
        done, need = done + len(chain), need - len(chain)
        bits.at += place
        if bits.at > bits.n:
            raise WebPError("the data ends early")
    green, red, blue = (flat[i::3].astype(np.uint32) for i in range(3))
    out[:] = np.uint32(alpha << 24) | red << np.uint32(16) | green << np.uint32(8) | blue


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int32) + b) >> 1).astype(np.int32)


def _clamp(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255)


def _predict(mode: int, left, top, top_right, top_left):
    """The predicted (..., 4) values as int32 of one of the 14 modes."""
    left, top, top_right, top_left = (np.asarray(x, np.int32) for x in (left, top, top_right, top_left))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        p = left + top - top_left
        nearer = np.abs(p - left).sum(-1, keepdims=True) < np.abs(p - top).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return _clamp(left + top - top_left)
    if mode == 13:
        mean = _half(left, top)
        diff = mean - top_left
        return _clamp(mean + np.where(diff < 0, -((-diff) // 2), diff // 2))
    black = np.zeros_like(left)
    black[..., 3] = 255
    return black


BIT = np.arange(8)
LEFTLESS = (0, 2, 3, 4, 8, 9)


def _invert_predictor(residual: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    """residual: (height, width, 4) bytes, turned into pixels in place, row by row.

    Rows whose blocks need no left neighbour, or only it, are done at once; others pixel by pixel.
    """
    height, width, _ = residual.shape
    residual[0, :1, 3] += np.uint8(255)
    residual[0] = np.cumsum(residual[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = residual[y], residual[y - 1]
        row[0] += above[0]
        own = modes[y >> step]
        if (own == 1).all():
            residual[y] = np.cumsum(row, axis=0, dtype=np.uint8)
            continue
        right_of = np.concatenate([above[1:], row[:1]])  # beyond the end: this row's first pixel
        for bx, mode in enumerate(own.tolist()):
            a, b = max(1, bx << step), min(width, (bx + 1) << step)
            if a >= b:
                continue
            if mode == 1:
                row[a:b] += 0
                row[a - 1 : b] = np.cumsum(row[a - 1 : b], axis=0, dtype=np.uint8)
            elif mode in LEFTLESS or mode > 13:
                row[a:b] += _predict(mode, above[a:b], above[a:b], right_of[a:b], above[a - 1 : b - 1]).astype(np.uint8)
            else:
                for x in range(a, b):
                    row[x] += _predict(mode, row[x - 1], above[x], right_of[x], above[x - 1]).astype(np.uint8)
    return residual


def _cross_delta(multiplier: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (multiplier.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def _spread(blocks: np.ndarray, step: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << step, axis=0)[:height], 1 << step, axis=1)[:, :width]


def _invert_cross_colour(image: np.ndarray, elements: np.ndarray, step: int) -> np.ndarray:
    height, width, _ = image.shape
    own = _spread(elements, step, height, width)
    green_to_red, green_to_blue, red_to_blue = own[..., 0], own[..., 1], own[..., 2]
    green, red = image[..., 1], image[..., 2]
    red = (red + _cross_delta(green_to_red, green)).astype(np.uint8)
    blue = (image[..., 0] + _cross_delta(green_to_blue, green) + _cross_delta(red_to_blue, red)).astype(np.uint8)
    image[..., 2], image[..., 0] = red, blue
    return image


def _unpack_indices(packed: np.ndarray, bundle: int, width: int) -> np.ndarray:
    """packed: (height, n) with 1 << bundle indices in each."""
    each = 8 >> bundle
    parts = packed[..., None] >> (np.arange(1 << bundle, dtype=np.uint8) * each) & ((1 << each) - 1)
    return parts.reshape(len(packed), -1)[:, :width]


def decode_vp8l(data: bytes) -> np.ndarray:
    """The (height, width) uint32 ARGB pixels of a VP8L stream."""
    bits = BitReader(data)
    if bits.read(8) != 0x2F:
        raise WebPError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    todo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            step = bits.read(3) + 2
            across, down = -(-now // (1 << step)), -(-height // (1 << step))
            todo.append((kind, step, _channels(_read_pixels(bits, across, down, False).reshape(down, across)), now))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, size, 1, False)), axis=0, dtype=np.uint8)
            bundle = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, bundle, table, now))
            now = -(-now // (1 << bundle))
        else:
            todo.append((kind, 0, None, now))
    image = _channels(_read_pixels(bits, now, height, True).reshape(height, now))
    for kind, step, own, wide in reversed(todo):
        if kind == PREDICTOR:
            image = _invert_predictor(image, own[..., 1] & 15, step)
        elif kind == CROSS_COLOUR:
            image = _invert_cross_colour(image, own, step)
        elif kind == SUBTRACT_GREEN:
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            table = np.zeros((256, 4), np.uint8)  # indices beyond the table are transparent black
            table[: len(own)] = own
            image = table[_unpack_indices(image[..., 1], step, wide)]
    return np.ascontiguousarray(image).view("<u4")[..., 0]


def decode_webp(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file; other chunks of the container are passed over."""
    return next(decode_all(data))


def decode_all(data: bytes):
    """The pixels of each of several WebP files that stand one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise WebPError("no WebP header")
        end, place, found = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, None
        while place + 8 <= end:
            size = struct.unpack_from("<I", data, place + 4)[0]
            if data[place : place + 4] == b"VP8L":
                found = data[place + 8 : place + 8 + size]
            place += 8 + size + (size & 1)
        if found is None:
            raise WebPError("no VP8L chunk")
        yield decode_vp8l(found)
        at = end


# ---------------------------------------------------------------- encoder


class BitWriter:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; counts are flattened until they fit."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, floor = counts[used].tolist(), 1
    while True:
        parent = [0] * (2 * len(used) - 1)
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for node in range(len(used), 2 * len(used) - 1):
            w, i = heapq.heappop(heap)
            v, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (w + v, node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        floor = max(2 * floor, 2)


def _put_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or max(used) < 256):  # a simple code
        used = used or [0]
        bits.put(1, 1)
        bits.put(len(used) - 1, 1)
        wide = used[0] > 1
        bits.put(int(wide), 1)
        bits.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            bits.put(used[1], 8)
        return
    tokens, held = [], lengths[: used[-1] + 1]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    runs = np.diff(np.append(first, len(held))).tolist()
    for length, run in zip(held[first].tolist(), runs, strict=True):
        if length:
            tokens.append((length, 0, 0))
            run -= 1
            while run >= 3:
                take = min(run, 6)
                tokens.append((16, take - 3, 2))
                run -= take
        else:
            while run >= 3:
                take = min(run, 138)
                tokens.append((18, take - 11, 7) if take > 10 else (17, take - 3, 3))
                run -= take
        tokens += [(length, 0, 0)] * run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical_codes(own).tolist()
    n = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1
    bits.put(0, 1)
    bits.put(max(n, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(n, 4)]:
        bits.put(int(own[s]), 3)
    cut = len(held) < len(lengths)
    bits.put(int(cut), 1)
    if cut:
        wide = max(0, (len(tokens) - 2).bit_length())
        size = max(1, -(-wide // 2))
        bits.put(size - 1, 3)
        bits.put(len(tokens) - 2, 2 * size)
    sizes = [0] * 19 if int((own > 0).sum()) == 1 else own.tolist()
    value, n = 0, 0
    for token, more, extra in tokens:
        value |= (codes[token] | more << sizes[token]) << n
        n += sizes[token] + extra
    bits.put(value, n)


def _pack(start: int, codes: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """The codes (of up to 31 bits each) one after another as one number; its bits."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    word, shifted = at >> 5, codes.astype(np.int64) << (at & 31)
    n = int(ends[-1] + 31 >> 5) + 2
    low = np.bincount(word, shifted & 0xFFFFFFFF, n) + np.concatenate([[0], np.bincount(word, shifted >> 32, n)[:-1]])
    return int.from_bytes(low.astype(np.uint32).tobytes(), "little"), int(ends[-1])


def _value_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of lengths or distance codes from 1 on."""
    v = np.asarray(value, np.int64) - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 0)
    extra = np.maximum(top - 1, 0)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    extra = np.where(v < 4, 0, extra)
    return symbol, v & ((1 << extra) - 1), extra


def _tokens(pixels: np.ndarray, cache_bits: int, references: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind (0 literal, 1 copy, 2 cached) with position or cache key, and length and distance of copies."""
    n = len(pixels)
    if not cache_bits and not references:
        return np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
    if not references:  # a pixel is cached if the last one of its key was the same
        keys = _cache_key(pixels, cache_bits).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        again = (keys[order[1:]] == keys[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
        hit = np.zeros(n, bool)
        hit[order[1:][again]] = True
        return np.where(hit, 2, 0), np.where(hit, keys, np.arange(n)), np.zeros(n, np.int64)
    values, kind, where, far = pixels.tolist(), [], [], []
    keys = _cache_key(pixels, cache_bits).tolist() if cache_bits else None
    cache, last, i = {}, {}, 0
    while i < n:
        run = 0
        if references and i + 3 <= n:
            seen = last.get((values[i], values[i + 1], values[i + 2]))
            if seen is not None:
                while i + run < n and run < 4096 and values[seen + run] == values[i + run]:
                    run += 1
        if run >= 3:
            kind.append(1), where.append(run), far.append(i - seen)
        elif cache_bits and cache.get(keys[i]) == values[i]:
            kind.append(2), where.append(keys[i]), far.append(0)
            run = 1
        else:
            kind.append(0), where.append(i), far.append(0)
            run = 1
        for j in range(i, i + run):
            if cache_bits:
                cache[keys[j]] = values[j]
            if references and j + 2 < n:
                last[(values[j], values[j + 1], values[j + 2])] = j
        i += run
    return np.array(kind), np.array(where), np.array(far)


def _put_pixels(bits: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    pixels = np.ascontiguousarray(pixels, "<u4").ravel()
    bits.put(int(cache_bits > 0), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    kind, where, far = _tokens(pixels, cache_bits, references)
    literal = pixels if not cache_bits and not references else pixels[where[kind == 0]]
    channels = literal.view(np.uint8).reshape(-1, 4)
    green = np.zeros(len(kind), np.int64)
    green[kind == 0] = channels[:, 1]
    copy = kind == 1
    if copy.any():
        len_symbol, len_extra, len_bits = _value_prefix(where[copy])
        far_symbol, far_extra, far_bits = _value_prefix(far[copy] + 120)
        green[copy] = 256 + len_symbol
    green[kind == 2] = 280 + where[kind == 2]
    size = 280 + (1 << cache_bits if cache_bits else 0)
    same = not copy.any() and not cache_bits
    if same:  # one histogram for the three colours: their codes are equal
        counts = np.bincount(channels[:, :3].ravel(), minlength=256)
        lengths = code_lengths(counts)
        all_lengths = [np.concatenate([lengths, np.zeros(24, np.int64)]), lengths, lengths]
    else:
        all_lengths = [code_lengths(np.bincount(green, minlength=size)), *(code_lengths(np.bincount(channels[:, c], minlength=256)) for c in (2, 0))]
    all_lengths += [code_lengths(np.bincount(channels[:, 3], minlength=256)), code_lengths(np.bincount(far_symbol, minlength=40)) if copy.any() else np.zeros(40, np.int64)]
    before: dict = {}
    for lengths in all_lengths:
        used = np.trim_zeros(lengths, "b").tobytes(), len(lengths) > 40 and lengths[-1] == 0
        if not used[1] or used not in before:
            own = BitWriter()
            _put_code(own, lengths)
            before[used] = own.value, own.n
        bits.put(*before[used])
    codes = [canonical_codes(x) for x in all_lengths[: 1 if same else 5]]
    if same:
        codes = [codes[0], codes[0], codes[0], canonical_codes(all_lengths[3]), np.zeros(40, np.int64)]
    sizes = [np.where((x > 0).sum() > 1, x, 0) for x in all_lengths]
    if literal is pixels and not sizes[3].any():  # nothing but colours
        order = channels[:, (1, 2, 0)]
        if same:
            value, wide = codes[0][order], sizes[1][order]
        else:
            value, wide = (np.stack([x[c][order[:, c]] for c in range(3)], axis=1) for x in (codes, sizes))
        bits.put(*_pack(0, value.ravel(), wide.ravel()))
        return
    # columns of each token: green, red, blue, alpha | green, length bits, distance, distance bits
    value, wide = np.zeros((len(kind), 4), np.int64), np.zeros((len(kind), 4), np.int64)
    value[:, 0], wide[:, 0] = codes[0][green], sizes[0][green]
    for column, (c, own) in enumerate(((2, 1), (0, 2), (3, 3)), 1):
        value[kind == 0, column], wide[kind == 0, column] = codes[own][channels[:, c]], sizes[own][channels[:, c]]
    if copy.any():
        for column, (v, w) in enumerate(((len_extra, len_bits), (codes[4][far_symbol], sizes[4][far_symbol]), (far_extra, far_bits)), 1):
            value[copy, column], wide[copy, column] = v, w
    bits.put(*_pack(0, value.ravel(), wide.ravel()))


def _mode_blocks(modes: np.ndarray) -> np.ndarray:
    return ALPHA | modes.astype(np.uint32) << np.uint32(8)


def encode_vp8l(
    pixels: np.ndarray,
    *,
    predictor: np.ndarray | None = None,
    cross_colour: np.ndarray | None = None,
    subtract_green: bool = False,
    palette: bool = False,
    step: int = 4,
    cache_bits: int = 0,
    references: bool = False,
) -> bytes:
    """A VP8L stream of (height, width) uint32 ARGB pixels.

    predictor: modes (0 to 13) of blocks of 1 << step pixels; cross_colour: (..., 3) multipliers of such
    blocks (green to red, green to blue, red to blue); palette: at most 256 colours.
    """
    height, width = pixels.shape
    if not 0 < height <= MAX_SIDE or not 0 < width <= MAX_SIDE:
        raise ValueError("an image side must be 1 to 16384")
    bits = BitWriter()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(int(bool((pixels & ALPHA != ALPHA).any())), 1)
    bits.put(0, 3)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette holds 256 colours")
        bits.put(1, 1)
        bits.put(PALETTE, 2)
        bits.put(len(colours) - 1, 8)
        table = _channels(colours)
        table = np.concatenate([table[:1], np.diff(table, axis=0)]) if len(table) > 1 else table
        _put_pixels(bits, np.ascontiguousarray(table).view("<u4")[:, 0], False)
        bundle = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index, each = index.reshape(height, width).astype(np.uint32), 8 >> bundle
        wide = -(-width // (1 << bundle))
        index = np.pad(index, ((0, 0), (0, wide * (1 << bundle) - width))).reshape(height, wide, 1 << bundle)
        pixels = ALPHA | (index << (np.arange(1 << bundle, dtype=np.uint32) * each)).sum(-1, dtype=np.uint32) << np.uint32(8)
        height, width = pixels.shape
    image = _channels(pixels).copy()
    if predictor is not None:
        bits.put(1, 1)
        bits.put(PREDICTOR, 2)
        bits.put(step - 2, 3)
        _put_pixels(bits, _mode_blocks(predictor), False)
        own = _spread(predictor, step, height, width)
        padded = np.pad(image, ((1, 0), (1, 1), (0, 0)))
        padded[1:-1, -1] = image[1:, 0] if height > 1 else 0  # right of a row's end stands the next row's first
        left, top, top_left, top_right = padded[1:, :-2], padded[:-1, 1:-1], padded[:-1, :-2], padded[:-1, 2:]
        guess = np.zeros((height, width, 4), np.int32)
        for mode in np.unique(own).tolist():
            guess = np.where((own == mode)[..., None], _predict(mode, left, top, top_right, top_left), guess)
        guess[0, 1:], guess[1:, 0] = image[0, :-1], image[:-1, 0]
        guess[0, 0] = (0, 0, 0, 255)
        image = (image - guess).astype(np.uint8)
    if cross_colour is not None:
        bits.put(1, 1)
        bits.put(CROSS_COLOUR, 2)
        bits.put(step - 2, 3)
        own = cross_colour.astype(np.uint32) & 255
        _put_pixels(bits, ALPHA | own[..., 2] << np.uint32(16) | own[..., 1] << np.uint32(8) | own[..., 0], False)
        own = _spread(cross_colour.astype(np.uint8), step, height, width)
        green, red = image[..., 1].copy(), image[..., 2].copy()
        image[..., 2] = (red - _cross_delta(own[..., 0], green)).astype(np.uint8)
        image[..., 0] = (image[..., 0] - _cross_delta(own[..., 1], green) - _cross_delta(own[..., 2], red)).astype(np.uint8)
    if subtract_green:
        bits.put(1, 1)
        bits.put(SUBTRACT_GREEN, 2)
        image[..., 0] -= image[..., 1]
        image[..., 2] -= image[..., 1]
    bits.put(0, 1)
    _put_pixels(bits, np.ascontiguousarray(image).view("<u4")[..., 0], True, cache_bits, references)
    return bits.bytes()


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_webp(pixels: np.ndarray, **how) -> bytes:
    return riff(encode_vp8l(pixels, **how))
