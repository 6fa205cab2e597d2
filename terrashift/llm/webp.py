"""Media columns: lossless WebP images written from bytes and decoded to pixel arrays.

``encode_payloads`` stores bytes as images 32 pixels wide, two samples (red and green) to a pixel, so
a row is 64 samples; long payloads become several images of at most 64 rows, one RIFF file after
another. Each image is written in the way that its entropy says is shortest: with a palette, packed
where it is small; or with a predictor chosen for every block, and cross-colour then or where it pays
alone; and with a colour cache where that pays. All have canonical prefix codes and
back-references for runs.

``decode_media`` reads any lossless WebP (VP8L) stream: prefix codes, back-references, colour cache,
and the predictor, cross-colour, subtract-green and palette transforms. It walks all images of a
batch in step, their codes too, one token of each at a time in numpy, and inverts predictors along
diagonals of all images. Images with several code groups, which are not written here, are read one by
one by ``decode_stream``, a plain decoder of all features that tests hold against the other.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal media; repeated rows
are stored one by one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import text_or_empty

#: Samples of a row, pixels of a row, rows of an image, and bytes of an image.
SAMPLES, WIDTH, TILE_ROWS = 64, 32, 64
TILE = SAMPLES * TILE_ROWS
#: What ``decode_media`` has inverted, by name, in this process.
INVERTED: Counter = Counter()

# Fixed values of the format: the order of code length codes, and alphabets of the five codes of a group.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_LITERALS, _LENGTHS, _DISTANCES = 256, 24, 40
_MAX_CODE = 15
# Short distances: pixels near the current one, by distance, then by column, the right side first.
_NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)

_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << _MAX_CODE)], np.int64)


# --- general decoder, one image at a time ---------------------------------------------------------


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return word & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)


class PrefixCode:
    """A canonical prefix code; codes of one symbol take no bits."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths)
        self.used = np.flatnonzero(lengths)
        self.table = None
        if len(self.used) == 0:
            raise ValueError("a prefix code has no symbol")
        if len(self.used) > 1:
            self.table = code_tables(lengths[None, :].astype(np.int64))[0].tolist()
            self.bits = (len(self.table) - 1).bit_length()

    def read(self, bits: Bits) -> int:
        if self.table is None:
            return int(self.used[0])
        entry = self.table[bits.peek(self.bits)]
        bits.at += entry >> 12
        return entry & 4095


def code_tables(lengths: np.ndarray) -> np.ndarray:
    """For each row of code lengths its lookup table: the next bits of a stream to symbol | length << 12.

    Canonical codes of a complete code are consecutive intervals of the bits read from the highest
    down, so a table is each symbol repeated; reversing the index's bits makes it fit the stream.
    """
    longest = int(lengths.max())
    if longest > _MAX_CODE or (np.where(lengths > 0, 1 << (longest - np.minimum(lengths, longest)), 0).sum(axis=1) != 1 << longest).any():
        raise ValueError("a prefix code is not complete")
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    order = np.lexsort((symbol, size, row))
    entry = symbol[order] | size[order] << 12
    tables = np.repeat(entry, 1 << (longest - size[order])).reshape(len(lengths), 1 << longest).astype(np.int32)
    return tables[:, _REVERSED[: 1 << longest] >> (_MAX_CODE - longest)]


def _read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    """Code lengths of one prefix code."""
    lengths = np.zeros(alphabet, np.int64)
    look = bits.peek(19)
    if look & 1:  # one or two symbols, as they are
        wide = 8 if look & 4 else 1
        lengths[look >> 3 & ((1 << wide) - 1)] = 1
        if look & 2:
            lengths[look >> (3 + wide) & 255] = 1
        bits.at += 3 + wide + (8 if look & 2 else 0)
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        return lengths
    bits.at += 1
    own = [0] * 19
    for place in _LENGTH_ORDER[: 4 + bits.read(4)]:
        own[place] = bits.read(3)
    code = _length_code(tuple(own))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, previous, held, word = 0, 8, 0, 0
    table, most = code.table, (code.bits if code.table else 0)
    while at < alphabet and left:
        left -= 1
        if held < 32:  # a symbol and its extra bits take 14 at most
            first = bits.at >> 3
            word = int.from_bytes(bits.data[first : first + 64], "little") >> (bits.at & 7)
            held = 504
        entry = table[word & ((1 << most) - 1)] if table else int(code.used[0])
        symbol, used = entry & 4095, entry >> 12
        if symbol < 16:
            lengths[at] = symbol
            previous = symbol or previous
            at += 1
        else:
            value, more, least = ((previous, 2, 3), (0, 3, 3), (0, 7, 11))[symbol - 16]
            repeat = least + (word >> used & ((1 << more) - 1))
            used += more
            if at + repeat > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + repeat] = value
            at += repeat
        word >>= used
        held -= used
        bits.at += used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return lengths


@lru_cache(maxsize=64)
def _length_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(list(lengths))


def _extra(bits: Bits, prefix: int) -> int:
    """The value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.read(more) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels (ARGB as one integer) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        groups_at = [(p >> 8) & 0xFFFF for p in _read_image(bits, across, -(-height >> block), False)]
    alphabets = (_LITERALS + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    groups = [[PrefixCode(_read_lengths(bits, a)) for a in alphabets] for _ in range(max(groups_at) + 1 if groups_at else 1)]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    total, cached = width * height, 0

    def fill() -> None:
        nonlocal cached
        for p in out[cached:]:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        cached = len(out)

    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, distance = groups[groups_at[(at // width >> block) * across + (at % width >> block)]] if groups_at else groups[0]
        symbol = green.read(bits)
        if symbol < _LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | symbol << 8 | b)
        elif symbol < _LITERALS + _LENGTHS:
            length = _extra(bits, symbol - _LITERALS)
            code = _extra(bits, distance.read(bits))
            back = code - 120 if code > 120 else max(1, _NEAR[code - 1][0] + _NEAR[code - 1][1] * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            fill()
            out.append(cache[symbol - _LITERALS - _LENGTHS])
    return out


def _planes(pixels: list[int] | np.ndarray, width: int) -> np.ndarray:
    """(height, width, 4) of alpha, red, green, blue."""
    return np.asarray(pixels).astype(">u4").view(np.uint8).reshape(-1, width, 4).astype(np.int64)


def _predict(mode: int, left, top, top_right, top_left):
    """What a predictor says of pixels (..., 4), from their neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode <= 9:
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        nearer = np.abs(top - top_left).sum(axis=-1, keepdims=True) < np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    middle = mean(left, top)
    return np.clip(middle + np.trunc((middle - top_left) / 2).astype(np.int64), 0, 255)


def _invert_predictor(image: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    height, width, _ = image.shape
    out = image.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = np.array([255, 0, 0, 0]) if x == 0 else out[0, x - 1]
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                top_right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predict(int(modes[y >> block, x >> block, 2]), out[y, x - 1], out[y - 1, x], top_right, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + guess) & 255
    return out


def _invert_cross_colour(image: np.ndarray, block: int, elements: np.ndarray) -> np.ndarray:
    height, width, _ = image.shape
    e = np.repeat(np.repeat(elements, 1 << block, axis=0), 1 << block, axis=1)[:height, :width]
    signed = lambda a: ((a & 255) ^ 128) - 128
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    out = image.copy()
    out[..., 1] = (image[..., 1] + delta(e[..., 3], image[..., 2])) & 255
    out[..., 3] = (image[..., 3] + delta(e[..., 2], image[..., 2]) + delta(e[..., 1], out[..., 1])) & 255
    return out


def _invert_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] = (image[..., 1] + image[..., 2]) & 255
    out[..., 3] = (image[..., 3] + image[..., 2]) & 255
    return out


def _invert_palette(image: np.ndarray, width: int, packed: int, palette: np.ndarray) -> np.ndarray:
    each = 8 >> packed
    indexes = (image[..., 2:3] >> (np.arange(1 << packed) * each)) & ((1 << each) - 1)
    indexes = indexes.reshape(len(image), -1)[:, :width]
    colours = np.zeros((256, 4), np.int64)
    colours[: len(palette)] = palette
    return colours[indexes]


def _chunk(riff: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L data of the RIFF file at ``at`` and where the next file starts."""
    if riff[at : at + 4] != b"RIFF" or riff[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size, length = struct.unpack_from("<I", riff, at + 4)[0], struct.unpack_from("<I", riff, at + 16)[0]
    return riff[at + 20 : at + 20 + length], at + 8 + size


def _size(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    size = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)  # whether alpha is used: a hint
    if bits.read(3):
        raise ValueError("unknown version")
    return size


def decode_stream(data: bytes) -> np.ndarray:
    """(height, width, 4) uint8 of alpha, red, green, blue of a VP8L stream."""
    bits = Bits(data)
    width, height = _size(bits)
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            across = -(-inner >> block)
            side = _planes(_read_image(bits, across, -(-height >> block), False), across)
            undo.append((lambda im, b=block, s=side: _invert_predictor(im, b, s)) if kind == 0 else (lambda im, b=block, s=side: _invert_cross_colour(im, b, s)))
        elif kind == 2:
            undo.append(_invert_green)
        else:
            colours = bits.read(8) + 1
            palette = np.cumsum(_planes(_read_image(bits, colours, 1, False), colours)[0], axis=0) & 255
            packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append(lambda im, w=inner, k=packed, p=palette: _invert_palette(im, w, k, p))
            inner = -(-inner >> packed)
    image = _planes(_read_image(bits, inner, height, True), inner)
    for step in reversed(undo):
        image = step(image)
    return image.astype(np.uint8)


def decode_image(riff: bytes) -> np.ndarray:
    return decode_stream(_chunk(riff)[0])


# --- encoder, many images at a time ---------------------------------------------------------------

#: Bits of the colour cache, and of the side of a predictor's block.
CACHE_BITS, BLOCK_BITS = 6, 3
#: Predictors that the encoder tries besides none: left, top, and left + top - top left.
_TRIED = (0, 1, 2, 12)
#: Cross-colour multipliers that it tries, in 32nds.
_MULTIPLIERS = (-16, 16, 32)
#: Images that are written together: few, so that their arrays stay in a core's cache; image and slot must fit into 16 bits.
MAX_IMAGES = 256
_RAREST = 1024  # rarer symbols count as one of so many: no code is longer than 11 bits


#: Code space that a code of each length takes up when it gets shorter by one; lengths of 0 and 1 never do.
_GAIN = np.array([1 << 30, 1 << 30] + [1 << (_MAX_CODE - n) for n in range(2, _MAX_CODE + 1)])


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete code lengths for each row of counts, near -log2 of the shares; rows of one used symbol get length 1 for it.

    Rounded-up lengths leave some code space; it goes to the most frequent symbols first, in turns,
    until it is used up: the longest code can always be shortened by what is left.
    """
    several = (counts > 0).sum(axis=1) > 1
    out = (counts > 0).astype(np.int64)
    if not several.any():
        return out
    symbols = np.flatnonzero(counts.any(axis=0))
    counts = counts[np.ix_(several, symbols)]
    counts = np.where(counts > 0, np.maximum(counts, counts.sum(axis=1, keepdims=True) / _RAREST), 0)
    total = counts.sum(axis=1, keepdims=True)
    want = np.ceil(np.log2(total / np.where(counts > 0, counts, 1))).astype(np.int64)
    lengths = np.where(counts > 0, np.clip(want, 1, _MAX_CODE), 0)
    order = np.argsort(-counts, axis=1, kind="stable")[:, : int((counts > 0).sum(axis=1).max())]
    ordered = np.ascontiguousarray(np.take_along_axis(lengths, order, axis=1).T)
    spare = (1 << _MAX_CODE) - np.where(ordered > 0, 1 << (_MAX_CODE - ordered), 0).sum(axis=0)
    while (spare > 0).any():
        for own in ordered:
            gain = _GAIN.take(own)
            take = gain <= spare
            own -= take
            spare -= gain * take
    np.put_along_axis(lengths, order, ordered.T, axis=1)
    out[np.ix_(several, symbols)] = lengths
    return out


def _stream_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row, bits in the order of the stream."""
    out, rows = np.zeros_like(lengths), len(lengths)
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol]
    group = row << 4 | size
    count = np.bincount(group, minlength=rows << 4).reshape(rows, 16)
    first = np.zeros_like(count)
    for n in range(1, 16):
        first[:, n] = (first[:, n - 1] + count[:, n - 1]) << 1
    order = np.argsort(group, kind="stable")
    codes = np.empty(len(group), np.int64)
    codes[order] = np.arange(len(group)) - (np.cumsum(count) - count.ravel() - first.ravel())[group[order]]
    out[row, symbol] = _REVERSED[codes] >> (_MAX_CODE - size)
    return out


# The code for code lengths is the same in all images: thirteen symbols of 4 bits, six of 5.
_OWN_LENGTHS = [4 if 1 <= s <= 10 or s in (0, 17, 18) else 5 for s in range(19)]
_OWN_CODES = _stream_codes(np.array([_OWN_LENGTHS], np.int64))[0].tolist()


def _text_bits(value: int, n: int) -> str:
    return f"{value:0{n}b}"[::-1] if n else ""


_OWN_TEXT = [_text_bits(c, n) for c, n in zip(_OWN_CODES, _OWN_LENGTHS, strict=True)]
_CODE_HEAD = "0" + _text_bits(15, 4) + "".join(_text_bits(_OWN_LENGTHS[s], 3) for s in _LENGTH_ORDER) + "0"


def _one_symbol(symbol: int) -> str:
    """A code of one symbol, which takes no bits."""
    return "101" + _text_bits(symbol, 8)


def _code_text(lengths: list[int]) -> str:
    """The bits that describe a code, as text of 0 and 1 in the order of the stream."""
    used = len(lengths) - lengths.count(0)
    if used == 1 and lengths.index(1) < 256:
        return _one_symbol(lengths.index(1))
    parts, at = [_CODE_HEAD], 0
    for i in [i for i, n in enumerate(lengths) if n]:
        parts.append(_zeros(i - at) + _OWN_TEXT[lengths[i]])
        at = i + 1
    return "".join(parts) + _zeros(len(lengths) - at)


@lru_cache(maxsize=512)
def _zeros(n: int) -> str:
    """The bits for ``n`` unused symbols in a row."""
    if n > 138:
        return _zeros(138) + _zeros(n - 138)
    return _OWN_TEXT[18] + _text_bits(n - 11, 7) if n >= 11 else _OWN_TEXT[17] + _text_bits(n - 3, 3) if n >= 3 else _OWN_TEXT[0] * n


def _number(text: str) -> int:
    return int(text[::-1] or "0", 2)


# The same for whole tables: bits for 0 to 344 unused symbols in a row, then one of each length.
_ZERO_BITS = np.array([len(_zeros(n)) for n in range(_LITERALS + _LENGTHS + (1 << CACHE_BITS) + 1)])
_ZERO_VALUE = np.array([_number(_zeros(n)) for n in range(len(_ZERO_BITS))], np.uint64)
_OWN_BITS, _OWN_VALUE = np.array(_OWN_LENGTHS), np.array(_OWN_CODES, np.uint64)


class Words:
    """Streams being written, each from a 64-bit word of one buffer on; ``at`` is the bit where each goes on."""

    def __init__(self, bits: np.ndarray):
        size = (bits + 63) // 64
        self.begin = self.at = 64 * (np.cumsum(size) - size)
        self.words = np.zeros(int(size.sum()) + 2, np.uint64)

    def put(self, owner: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Tokens of at most 64 bits, by stream."""
        total = np.bincount(owner, bits, len(self.at)).astype(np.int64)
        start = np.cumsum(bits) - bits + (self.at - np.cumsum(total) + total)[owner]
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        groups = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        if len(owner):
            self.words[word[groups]] |= np.add.reduceat(value << shift, groups)  # bits don't overlap: a sum is an or
        over = np.flatnonzero((start & 63) + bits > 64)
        self.words[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        self.at = self.at + total

    def put_one(self, value: np.ndarray | int, bits: np.ndarray | int) -> None:
        """One token for each stream."""
        n = len(self.at)
        self.put(np.arange(n), np.broadcast_to(np.asarray(value, np.uint64), n), np.broadcast_to(bits, n))


def _code_tokens(lengths: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_code_text`` gives for each row cut at its size, as (row, value, bits) of tokens, three parts one after another."""
    row, symbol = np.nonzero(lengths)
    used, rows = np.bincount(row, minlength=len(lengths)), np.arange(len(lengths))
    last = symbol[np.cumsum(used) - 1]
    one = (used == 1) & (last < 256)
    zeros = np.diff(symbol, prepend=-1) - 1
    first = np.cumsum(used) - used
    zeros[first] = symbol[first]
    own = lengths[row, symbol]
    kept = ~one[row]
    value = _ZERO_VALUE[zeros] | _OWN_VALUE[own] << _ZERO_BITS[zeros].astype(np.uint64)
    left = np.where(one, 0, sizes - 1 - last)
    return [
        (rows, np.where(one, 5 | last << 3, _number(_CODE_HEAD)).astype(np.uint64), np.where(one, 11, len(_CODE_HEAD))),
        (row[kept], value[kept], (_ZERO_BITS[zeros] + _OWN_BITS[own])[kept]),
        (rows, _ZERO_VALUE[left], _ZERO_BITS[left]),
    ]


def _side_images(images: list[np.ndarray]) -> list[str]:
    """Images of transforms (palettes, modes or multipliers), rows of alpha, red, green and blue: literals only."""
    if not images:
        return []
    sizes = np.fromiter(map(len, images), np.int64, len(images))
    owner = np.repeat(np.arange(len(images)), sizes)
    every = np.concatenate(images)
    n = len(images)
    channels = [every[:, c] for c in (2, 1, 3, 0)]  # green, red, blue, alpha
    lengths = _code_lengths(np.concatenate([_histograms(owner, c, n, _LITERALS + _LENGTHS) for c in channels]))
    texts = [_code_text(row if k < n else row[:256]) for k, row in enumerate(lengths.tolist())]
    taken = np.where((lengths > 0).sum(axis=1, keepdims=True) > 1, lengths, 0)
    codes = _stream_codes(taken)
    value, bits = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for k, channel in enumerate(channels):
        value |= codes[owner + k * n, channel] << bits
        bits += taken[owner + k * n, channel]
    pixels, ends = [_text_bits(v, b) for v, b in zip(value.tolist(), bits.tolist(), strict=True)], np.cumsum(sizes).tolist()
    return ["0" + "".join(texts[i::n]) + _one_symbol(0) + "".join(pixels[e - m : e]) for i, (e, m) in enumerate(zip(ends, sizes.tolist(), strict=True))]


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of each length."""
    v = values - 1
    top = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 0)
    more = np.maximum(top - 1, 0)
    return np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1)), np.where(v < 4, 0, more), np.where(v < 4, 0, v & ((1 << more) - 1))


def _histograms(owner: np.ndarray, values: np.ndarray, images: int, size: int = 256) -> np.ndarray:
    return np.bincount(owner * size + values, minlength=images * size).reshape(images, size)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits of all symbols of each row by its entropy, and some for describing the code."""
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(axis=1) + 4 * (counts > 0).sum(axis=1)


def _predicted(planes: np.ndarray, start: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Residuals of the images for which predictors pay, other images as they are, bits of each, and the modes of the former's blocks.

    A block takes the predictor whose residuals seem cheapest: a raw sample costs what its share in
    the image says, a residual the more bits the farther it is from zero. The first row and column
    have predictors of their own.
    """
    images, size = len(rows), planes.shape[1]
    high, across = -(-rows >> BLOCK_BITS), WIDTH >> BLOCK_BITS
    first = across * (np.cumsum(high) - high)
    tops = start // WIDTH  # the row of all on which each image begins
    row = np.arange(size // WIDTH) - np.repeat(tops, rows)
    block = ((np.repeat(first, rows) + (row >> BLOCK_BITS) * across)[:, None] + (np.arange(WIDTH) >> BLOCK_BITS)).ravel()
    at = lambda back: np.concatenate((planes[:, :1].repeat(back, axis=1), planes[:, :-back]), axis=1)[:, :size]
    left, top, corner = at(1), at(WIDTH), at(WIDTH + 1)
    slope = np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    by_left, by_top = planes - left, planes - top  # of bytes: modulo 256
    grid = lambda a: a.reshape(2, -1, WIDTH)
    tried = [planes.copy(), by_left.copy(), by_top.copy(), planes - slope]
    for t in tried:
        grid(t)[:, :, 0] = grid(by_top)[:, :, 0]
        grid(t)[:, tops] = grid(by_left)[:, tops]
        grid(t)[:, tops, 0] = grid(planes)[:, tops, 0]
    price = (1 + 2 * np.log2(1 + np.abs((np.arange(256) ^ 128) - 128.0))).astype(np.float32)
    counts = [_histograms(owner, p, images) for p in planes]
    own = [np.log2((c.sum(axis=1, keepdims=True) + 256) / (c + 1)).astype(np.float32).ravel() for c in counts]
    raw = owner << 8
    costs = [np.bincount(block, own[0].take(raw | planes[0]) + own[1].take(raw | planes[1]) if m == 0 else price.take(t[0]) + price.take(t[1]), int(across * high.sum())) for m, t in zip(_TRIED, tried, strict=True)]
    chosen = np.argmin(np.stack(costs), axis=0)
    before = sum(map(_bits, counts))
    several = np.minimum.reduceat(chosen, first) != np.maximum.reduceat(chosen, first)
    describing = 70 + several * (80 + 2 * across * high)
    # entropy decides, but only where the blocks' costs already promise enough
    hoped = np.flatnonzero(np.add.reduceat(costs[0] - np.min(np.stack(costs), axis=0), first) > describing)
    out, modes = planes, [None] * images
    bits = before
    if len(hoped):
        rank = np.full(images, -1)
        rank[hoped] = np.arange(len(hoped))
        own_rank = rank[owner]
        mine = np.flatnonzero(own_rank >= 0)
        residual = np.choose(chosen[block[mine]], [t[:, mine] for t in tried])
        after = sum(_bits(_histograms(own_rank[mine], p, len(hoped))) for p in residual) + describing[hoped]
        pays = after < before[hoped]
        out, bits = planes.copy(), before.copy()
        kept = pays[own_rank[mine]]
        out[:, mine[kept]] = residual[:, kept]
        bits[hoped[pays]] = after[pays]
        for i in hoped[pays].tolist():
            modes[i] = np.array(_TRIED)[chosen[first[i] : first[i] + across * high[i]]]
    return out, bits, modes


def _uncrossed(planes: np.ndarray, owner: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red less a multiple of green, the bits saved, and each image's multiplier.

    An image with a predictor takes the best multiplier, any other only one that pays, else 0 for none.
    """
    images = len(predicted)
    red, green = planes
    signed = (np.arange(256) ^ 128) - 128
    shares = np.array([(m * signed) >> 5 & 255 for m in (0, *_MULTIPLIERS)]).astype(np.uint8)  # what green takes from red
    plain = _bits(_histograms(owner, red, images))
    best, chosen = np.where(predicted, np.inf, plain - 70), np.zeros(images, np.int64)
    for k in range(1, len(shares)):
        bits = _bits(_histograms(owner, red - shares[k].take(green), images))
        chosen = np.where(bits < best, k, chosen)
        best = np.minimum(best, bits)
    if chosen.any():
        red = red - shares[chosen[owner], green]
    return red, np.where(chosen != 0, plain - best - 70, 0), np.array((0, *_MULTIPLIERS))[chosen]


def _encode_tiles(tiles: list[bytes]) -> list[bytes]:
    """One RIFF file for each tile (a multiple of 64 bytes, at most TILE)."""
    images = len(tiles)
    rows = np.fromiter(map(len, tiles), np.int64, images) // SAMPLES
    planes = np.ascontiguousarray(np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 2).T)  # red and green
    pixels = rows * WIDTH
    start = np.cumsum(pixels) - pixels
    owner = np.repeat(np.arange(images), pixels)
    # predictor, then cross-colour
    residual, bits, modes = _predicted(planes, start, rows, owner)
    crossed, saved, multipliers = _uncrossed(residual, owner, np.array([m is not None for m in modes]))
    # or a palette, where the entropy of indexes and the colours themselves take less
    ranked = np.sort(owner.astype(np.uint32) << 16 | planes[0].astype(np.uint32) << 8 | planes[1])
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    colours, counts = ranked[begin].astype(np.int64), np.diff(np.append(begin, len(ranked)))
    of_colour = colours >> 16
    n_colours = np.bincount(of_colour, minlength=images)
    first_colour = np.cumsum(n_colours) - n_colours
    by_index = np.bincount(of_colour, counts * np.log2(pixels[of_colour] / counts), images) + 16 * n_colours + 160
    palette = (n_colours <= 256) & (by_index < bits - saved)
    packed = np.where(n_colours <= 2, 3, np.where(n_colours <= 4, 2, np.where(n_colours <= 16, 1, 0)))
    # what is coded: pixels of one channel for palettes, of two for the others
    coded_r, coded_g, alphas = [None] * images, [None] * images, np.full(images, 255)
    for i in np.flatnonzero(palette).tolist():
        own = colours[first_colour[i] : first_colour[i] + n_colours[i]] & 0xFFFF
        k = int(packed[i])
        each = 8 >> k
        its = planes[:, start[i] : start[i] + pixels[i]].astype(np.int64)
        ids = np.searchsorted(own, its[0] << 8 | its[1]).reshape(-1, 1 << k)
        coded_g[i] = (ids << (each * np.arange(1 << k))).sum(axis=1).astype(np.uint8)
        coded_r[i] = np.zeros(len(ids), np.uint8)
    for i in np.flatnonzero(~palette).tolist():
        coded_r[i], coded_g[i] = crossed[start[i] : start[i] + pixels[i]], residual[1, start[i] : start[i] + pixels[i]]
        if modes[i] is not None:
            alphas[i] = 0  # all predictors give full alpha
    sides: list[tuple[int, str, np.ndarray]] = []  # image, what stands before, and the image of each transform
    for i in np.flatnonzero(palette).tolist():
        own = colours[first_colour[i] : first_colour[i] + n_colours[i]] & 0xFFFF
        argb = np.stack([np.full(len(own), 255), own >> 8, own & 255, np.zeros(len(own), np.int64)], axis=1)
        sides.append((i, "1" + _text_bits(3, 2) + _text_bits(len(own) - 1, 8), np.diff(argb, axis=0, prepend=0) & 255))
    for i in np.flatnonzero(~palette & np.array([m is not None for m in modes])).tolist():
        side = np.zeros((len(modes[i]), 4), np.int64)
        side[:, 0], side[:, 2] = 255, modes[i]
        sides.append((i, "1" + _text_bits(0, 2) + _text_bits(BLOCK_BITS - 2, 3), side))
    for i in np.flatnonzero(~palette & (multipliers != 0)).tolist():
        # green to red is in blue; one block holds the whole image
        sides.append((i, "1" + _text_bits(1, 2) + _text_bits(7, 3), np.array([[255, 0, 0, int(multipliers[i]) & 255]])))
    transforms = [""] * images
    for (i, head, _), text in zip(sides, _side_images([side for *_, side in sides]), strict=True):
        transforms[i] += head + text
    return _entropy_code(rows, transforms, coded_r, coded_g, alphas)


def _entropy_code(rows: np.ndarray, transforms: list[str], coded_r: list[np.ndarray], coded_g: list[np.ndarray], alphas: np.ndarray) -> list[bytes]:
    """The RIFF files: rows and transforms of each image, and its coded pixels as red, green and one alpha."""
    images = len(rows)
    pixels = np.fromiter(map(len, coded_g), np.int64, images)
    owner = np.repeat(np.arange(images), pixels)
    red, green = np.concatenate(coded_r), np.concatenate(coded_g)
    pair = red.astype(np.uint16) << 8 | green
    # runs of one pixel: its first is a literal, the rest a back-reference where there are three or more
    same = np.zeros(len(green), bool)
    same[1:] = pair[1:] == pair[:-1]
    same[np.cumsum(pixels)[:-1]] = False
    begin = np.flatnonzero(~same)
    length = np.diff(np.append(begin, len(green)))
    begin, length = begin[length > 3], length[length > 3] - 1
    token, run = np.ones(len(green), bool), np.zeros(len(green), bool)
    inner = np.repeat(begin + 2 - np.cumsum(length - 1) + (length - 1), length - 1) + np.arange(int((length - 1).sum()))
    token[inner], run[begin + 1] = False, True
    at = np.flatnonzero(token)
    is_run = run[at]
    # the cache holds the last pixel of each hash: a hit is a pixel equal to the one before with its hash
    argb = np.repeat(alphas.astype(np.uint32) << 24, pixels) | pair.astype(np.uint32) << 8
    slot = ((argb * np.uint32(0x1E35A7BD)) >> np.uint32(32 - CACHE_BITS)).astype(np.uint16)
    place = owner.astype(np.uint16) << CACHE_BITS | slot
    order = np.argsort(place, kind="stable")  # a radix sort
    hit = np.zeros(len(green), bool)
    ranked, place = pair[order], place[order]
    hit[order[1:]] = (ranked[1:] == ranked[:-1]) & (place[1:] == place[:-1])
    of_token = owner[at]
    is_hit = hit[at] & ~is_run
    prefix, more, extra = _prefix_of(length)
    symbol, reds_at = green[at].astype(np.int64), red[at]
    symbol[is_run] = _LITERALS + prefix
    cached = symbol.copy()
    cached[is_hit] = _LITERALS + _LENGTHS + slot[at][is_hit].astype(np.int64)
    alphabet = _LITERALS + _LENGTHS + (1 << CACHE_BITS)
    literal = ~is_run
    without = _histograms(of_token, symbol, images, alphabet), _histograms(of_token[literal], reds_at[literal], images)
    missed = literal & ~is_hit
    with_ = _histograms(of_token, cached, images, alphabet), _histograms(of_token[missed], reds_at[missed], images)
    uses = _bits(with_[0]) + _bits(with_[1]) < _bits(without[0]) + _bits(without[1])
    symbol = np.where(uses[of_token], cached, symbol)
    literal = np.flatnonzero(np.where(uses[of_token], missed, literal))
    greens = _code_lengths(np.where(uses[:, None], with_[0], without[0]))
    reds = _code_lengths(np.where(uses[:, None], with_[1], without[1]))

    def coded(lengths: np.ndarray, which: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their bits; a code of one symbol takes none."""
        taken = np.where((lengths > 0).sum(axis=1, keepdims=True) > 1, lengths, 0)
        both = (_stream_codes(taken) << 4 | taken).astype(np.uint32).ravel().take(which * lengths.shape[1] + symbols)
        return (both >> 4).astype(np.uint64), (both & 15).astype(np.int64)

    value, bits = coded(greens, of_token, symbol)
    value[is_run] |= extra.astype(np.uint64) << bits[is_run].astype(np.uint64)
    bits[is_run] += more
    second, second_bits = coded(reds, of_token[literal], reds_at[literal])
    value[literal] |= second << bits[literal].astype(np.uint64)
    bits[literal] += second_bits
    codes = _code_tokens(greens, np.where(uses, alphabet, _LITERALS + _LENGTHS)) + _code_tokens(reds, np.full(images, 256))
    text_bits = np.fromiter(map(len, transforms), np.int64, images)
    fixed_bits = 40 + text_bits + np.where(uses, 7, 3) + 33
    out = Words(fixed_bits + sum(np.bincount(o, b, images) for o, _, b in [*codes, (of_token, None, bits)]).astype(np.int64))
    out.put_one(0x2F | WIDTH - 1 << 8 | rows - 1 << 22, 40)
    for i in np.flatnonzero(text_bits).tolist():
        begin = int(out.at[i]) // 8  # the 40 bits before are whole bytes
        text = _number(transforms[i]).to_bytes((len(transforms[i]) + 7) // 8, "little")
        out.words.view(np.uint8)[begin : begin + len(text)] |= np.frombuffer(text, np.uint8)
    out.at = out.at + text_bits
    # no more transforms, the cache, one group of codes
    out.put_one(np.where(uses, 2 | CACHE_BITS << 2, 0), np.where(uses, 7, 3))
    for part in codes:
        out.put(*part)
    # blue 0, one alpha, and distance prefix 1, the pixel to the left, are codes of one symbol
    out.put_one(5 | (5 | alphas << 3) << 11 | (5 | 1 << 3) << 22, 33)
    out.put(of_token, value, bits)
    return _riff(out)


def _riff(out: Words) -> list[bytes]:
    """The file of each stream."""
    buffer, files = out.words.tobytes(), []
    for begin, n in zip((out.begin // 8).tolist(), ((out.at - out.begin + 7) // 8).tolist(), strict=True):
        files.append(b"RIFF" + struct.pack("<I", 12 + n + (n & 1)) + b"WEBPVP8L" + struct.pack("<I", n) + buffer[begin : begin + n] + b"\0" * (n & 1))
    return files


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The media of each payload (a positive multiple of 64 bytes): its images one after another."""
    tiles = [p[i : i + TILE] for p in payloads for i in range(0, len(p), TILE)]
    files = [f for i in range(0, len(tiles), MAX_IMAGES) for f in _encode_tiles(tiles[i : i + MAX_IMAGES])]
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // TILE)
        out.append(files[at] if n == 1 else b"".join(files[at : at + n]))
        at += n
    return out


# --- decoder of many images in step ---------------------------------------------------------------


class Streams:
    """The streams of a batch in one buffer, each followed by zeros; places are bits of the buffer."""

    def __init__(self, streams: list[bytes]):
        sizes = np.fromiter(map(len, streams), np.int64, len(streams)) + 8
        raw = b"".join([s + bytes(8) for s in streams])
        # the eight bytes from each place on, as one number
        self.window = np.ndarray(len(raw) - 7, "<i8", raw, strides=(1,)).astype(np.int64)
        self.at = 8 * (np.cumsum(sizes) - sizes)
        self.limit = self.at + 8 * sizes - 63

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits from each place on; above them stands anything."""
        return self.window.take(at >> 3) >> (at & 7)


def _ended(at: np.ndarray, limit: np.ndarray) -> None:
    if (at >= limit).any():
        raise ValueError("a stream ends early")


#: What a symbol of a code for code lengths stands for: least number of repeats, and bits that add to it.
_LEAST, _MORE = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])


def _read_codes(s: Streams, at: np.ndarray, limit: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of one prefix code from each place on, a row each, and where they end; one token of each at a time."""
    lengths = np.zeros((len(at), int(alphabets.max())), np.uint8)
    look, at = s.peek(at), at.copy()
    plain = np.flatnonzero(look & 1)  # one or two symbols, as they are
    if len(plain):
        own = look[plain]
        wide, two = np.where(own & 4, 8, 1), own >> 1 & 1
        first = own >> 3 & ((1 << wide) - 1)
        second = np.where(two, own >> (3 + wide) & 255, first)
        if (np.maximum(first, second) >= alphabets[plain]).any():
            raise ValueError("a code has a symbol outside its alphabet")
        lengths[plain, first] = lengths[plain, second] = 1
        at[plain] += 3 + wide + 8 * two
    lane = np.flatnonzero(~look & 1)
    if len(lane):
        number = 4 + (look[lane] >> 1 & 15)
        place = at[lane] + 5
        look = s.peek(np.minimum(place, limit[lane]))
        own = np.zeros((len(lane), 19), np.uint8)
        for k, symbol in enumerate(_LENGTH_ORDER):
            own[:, symbol] = np.where(k < number, look >> 3 * k & 7, 0)
        place = np.minimum(place + 3 * number, limit[lane])
        table, most = _lookup(own)
        look = s.peek(place)
        wide = 2 + 2 * (look >> 1 & 7)
        fewer = look & 1 == 1
        left = np.where(fewer, 2 + (look >> 4 & ((1 << wide) - 1)), alphabets[lane])
        place += np.where(fewer, 4 + wide, 1)
        row, size, end = np.arange(len(lane)) << most, alphabets[lane], limit[lane]
        filled, previous, mask = np.zeros(len(lane), np.int64), np.full(len(lane), 8), (1 << most) - 1
        while len(lane):
            place = np.minimum(place, end)
            look = s.peek(place)
            entry = table.take(row + (look & mask)).astype(np.int64)
            symbol, used = entry >> 4, entry & 15
            value, repeat = symbol, 1
            if (symbol > 15).any():
                more = _MORE.take(symbol)
                repeat = _LEAST.take(symbol) + (look >> used & ((1 << more) - 1))
                used += more
                value = np.where(symbol == 16, previous, np.where(symbol > 16, 0, symbol))
                for i in np.flatnonzero(symbol == 16).tolist():
                    lengths[lane[i], filled[i] : filled[i] + repeat[i]] = value[i]
            if (filled + repeat > size).any():
                raise ValueError("too many code lengths")
            single = np.flatnonzero((symbol > 0) & (symbol < 16))
            lengths[lane[single], filled[single]] = symbol[single]
            previous[single] = symbol[single]
            filled, place, left = filled + repeat, place + used, left - 1
            open_ = (filled < size) & (left > 0)
            if not open_.all():
                at[lane] = place
                lane, row, size, end, filled, previous, place, left = (x[open_] for x in (lane, row, size, end, filled, previous, place, left))
    at = np.minimum(at, limit)
    _ended(at, limit)
    return lengths, at


def _lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """One flat table for the codes of all rows: the next bits of a stream to symbol << 4 | length, and the number of bits."""
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol].astype(np.int64)
    size[(np.bincount(row, minlength=len(lengths)) == 1)[row]] = 0  # a code of one symbol takes no bits
    longest = int(size.max(initial=0))
    space = np.bincount(row, 1 << (longest - size), len(lengths))
    if (space != 1 << longest).any():
        raise ValueError("a prefix code is not complete")
    order = np.argsort(row << 4 | size, kind="stable")
    size = size[order]
    tables = np.repeat((symbol[order] << 4 | size).astype(np.uint16), 1 << (longest - size)).reshape(len(lengths), 1 << longest)
    return tables.take(_REVERSED[: 1 << longest] >> (_MAX_CODE - longest), axis=1).ravel(), longest


def _read_pixels(s: Streams, at: np.ndarray, limit: np.ndarray, width: np.ndarray, height: np.ndarray, cache_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The coded pixels (ARGB) of an image of one group from each place on, and where they end; one token of each at a time.

    A token is a literal, a pixel of the cache, or a back-reference.
    """
    count, codes = len(at), []
    for size in (_LITERALS + _LENGTHS + np.where(cache_bits, 1 << cache_bits, 0), 256, 256, 256, _DISTANCES):
        lengths, at = _read_codes(s, at, limit, np.broadcast_to(size, count))
        codes.append(_lookup(lengths))
    (greens, gb), (reds, rb), (blues, bb), (alphas, ab), (distances, db) = codes
    pixels = width * height
    out = np.zeros(int(pixels.sum()), np.uint32)
    end = np.cumsum(pixels)
    begin = to = end - pixels
    most = int(cache_bits.max())
    cache = np.zeros(count << most, np.uint32)
    # blue and alpha where all images have one value each
    fixed, varied = np.zeros(count, np.int64), []
    for table, nb, up in ((blues, bb, 0), (alphas, ab, 24)):
        if nb:
            varied.append((table, nb, up))
        else:
            fixed |= (table.astype(np.int64) >> 4) << up
    # where distances take no bits, as those written here
    back = _distance(distances.astype(np.int64) >> 4, width) if not db and int(distances.max()) >> 4 < 4 else None
    lane, ends = np.arange(count), at.copy()
    base, second, slots = lane << gb, lane << rb, lane << most
    shift = (32 - np.where(cache_bits, cache_bits, most or 1)).astype(np.uint32)
    mask, red_mask = (1 << gb) - 1, (1 << rb) - 1
    factor = np.uint32(0x1E35A7BD)
    while len(lane):
        look = s.peek(at)
        entry = greens.take((look & mask) + base).astype(np.int64)
        symbol, used = entry >> 4, entry & 15
        look >>= used
        entry = reds.take((look & red_mask) + second).astype(np.int64)
        made = (entry >> 4 << 16) | (symbol << 8) | fixed
        entry &= 15
        used += entry
        for table, nb, up in varied:
            e = table.take((lane << nb) + (s.peek(np.minimum(at + used, limit)) & ((1 << nb) - 1))).astype(np.int64)
            made |= e >> 4 << up
            used += e & 15
        made = made.astype(np.uint32)
        at = at + used
        other = np.flatnonzero(symbol >= _LITERALS)
        runs = ()
        if len(other):
            code = symbol[other]
            # no literal: only the green code was read
            place = at[other] - used[other]
            place = np.minimum(place + (greens.take(base[other] + (s.peek(place) & mask)) & 15), limit[other])
            if most:
                hit = code >= _LITERALS + _LENGTHS
                made[other] = cache.take(slots[other] + np.where(hit, code - _LITERALS - _LENGTHS, 0))
                runs = np.flatnonzero(~hit)
            else:
                runs = np.arange(len(other))
            at[other] = place
        if len(runs):
            mine = other[runs]
            length, place = _values(code[runs] - _LITERALS, place[runs], s, limit[mine])
            if back is None:
                e = distances.take((lane[mine] << db) + (s.peek(place) & ((1 << db) - 1))).astype(np.int64)
                far, place = _values(e >> 4, np.minimum(place + (e & 15), limit[mine]), s, limit[mine])
                behind = _distance(far - 1, width[mine])
            else:
                behind = back[lane[mine]]
            at[mine] = place
            start = to[mine]
            if (behind > start - begin[mine]).any() or (start + length > end[mine]).any():
                raise ValueError("a back-reference leaves the image")
            made[mine] = out[start - 1]  # the cache has the pixel before already
            to = to.copy()
            to[mine] += length - 1
            one = behind == 1
            same = length[one]
            out[np.repeat(start[one] - np.cumsum(same) + same, same) + np.arange(int(same.sum()))] = np.repeat(made[mine[one]], same)
            for i in np.flatnonzero(~one).tolist():
                first, n, k = int(start[i]), int(length[i]), int(behind[i])
                for p in range(first, first + n, k):
                    out[p : min(p + k, first + n)] = out[p - k : min(p, first + n - k)]
                made[mine[i]] = out[first + n - 1]
                if most:  # of pixels in one slot the last stays
                    cache[slots[mine[i]] + (out[first : first + n] * factor >> shift[mine[i]])] = out[first : first + n]
        out[to] = made
        to = to + 1
        if most:
            cache[slots + (made * factor >> shift)] = made
        at = np.minimum(at, limit)
        open_ = to < end
        if not open_.all():
            ends[lane] = at
            lane, at, limit, base, second, slots, shift, fixed, to, begin, end, width = (x[open_] for x in (lane, at, limit, base, second, slots, shift, fixed, to, begin, end, width))
    return np.split(out, np.cumsum(pixels)[:-1]), ends


_NEAR_XY = np.array(_NEAR, np.int64)


def _distance(code: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Pixels back that distance codes, counted from 0, stand for."""
    near = _NEAR_XY[np.minimum(code, 119)]
    return np.where(code > 119, code - 119, np.maximum(1, near[:, 0] + near[:, 1] * width))


def _values(prefix: np.ndarray, at: np.ndarray, s: Streams, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of length or distance prefixes, and where their extra bits end."""
    more = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    extra = s.peek(at) & ((1 << more) - 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << more) + extra + 1), np.minimum(at + more, limit)


def _invert_predictors(images: list[np.ndarray], blocks: list[int], modes: list[np.ndarray]) -> list[np.ndarray]:
    """Predicted images of one width: along diagonals, two rows down for one pixel to the left, all pixels are independent."""
    width, high = images[0].shape[1], max(len(im) for im in images)
    out = np.zeros((len(images), high, width, 4), np.int64)
    mode = np.zeros((len(images), high, width), np.int64)
    for i, (image, block, table) in enumerate(zip(images, blocks, modes, strict=True)):
        out[i, : len(image)] = image
        mode[i, : len(image)] = np.repeat(np.repeat(table[..., 2], 1 << block, axis=0), 1 << block, axis=1)[: len(image), :width]
    mode[mode > 13] = 0
    mode[:, 0, :], mode[:, :, 0] = 1, 2
    mode[:, 0, 0] = 0
    for s in range(width + 2 * (high - 1)):
        y = np.arange(max(0, -(-(s - width + 1) // 2)), min(high - 1, s // 2) + 1)
        x = s - 2 * y
        above = np.maximum(y - 1, 0)
        left, top, corner = out[:, y, np.maximum(x - 1, 0)], out[:, above, x], out[:, above, np.maximum(x - 1, 0)]
        # the last pixel of a row has the first of its own row for the one above to the right
        right = out[:, np.where(x == width - 1, y, above), (x + 1) % width]
        own = mode[:, y, x]
        guess = np.zeros_like(left)
        for m in np.unique(own).tolist():
            which = own == m
            guess[which] = _predict(m, left[which], top[which], right[which], corner[which])
        out[:, y, x] = (out[:, y, x] + guess) & 255
    return [o[: len(im)] for o, im in zip(out, images, strict=True)]


def _undone(images: list[np.ndarray], left: list[list[tuple]]) -> list[np.ndarray]:
    """The images with their transforms inverted, predictors of all images together."""
    while any(left):
        waiting: dict[int, list[int]] = {}
        for i, steps in enumerate(left):
            while steps and steps[-1][0] != 0:
                kind, *of = steps.pop()
                INVERTED[("predictor", "cross-colour", "subtract-green", "palette")[kind]] += 1
                images[i] = _invert_cross_colour(images[i], *of) if kind == 1 else _invert_green(images[i]) if kind == 2 else _invert_palette(images[i], *of)
            if steps:
                waiting.setdefault(images[i].shape[1], []).append(i)
        for same in waiting.values():
            steps = [left[i].pop() for i in same]
            INVERTED["predictor"] += len(same)
            for i, image in zip(same, _invert_predictors([images[i] for i in same], [s[1] for s in steps], [s[2] for s in steps]), strict=True):
                images[i] = image
    return images


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """(height, width, 4) uint8 of alpha, red, green, blue of each VP8L stream."""
    if not streams:
        return []
    s = Streams(streams)
    at, limit = s.at.copy(), s.limit
    look = s.peek(at)
    if (look & 255 != 0x2F).any():
        raise ValueError("not a VP8L stream")
    if (look >> 37 & 7).any():
        raise ValueError("unknown version")
    width, height = (look >> 8 & 0x3FFF) + 1, (look >> 22 & 0x3FFF) + 1
    undo: list[list[tuple]] = [[] for _ in streams]
    inner, open_ = width.copy(), np.arange(len(streams))
    at += 40
    while len(open_):  # the next transform of each stream that has one
        _ended(at, limit)
        look = s.peek(at[open_])
        at[open_] += 1
        open_, look = open_[look & 1 == 1], look[look & 1 == 1]
        kind, of = look >> 1 & 3, look >> 3
        at[open_] += np.array([5, 5, 2, 10])[kind]
        for i in open_[kind == 2].tolist():
            undo[i].append((2,))
        sided = kind != 2
        own, kinds, of = open_[sided], kind[sided], of[sided]
        if len(own):
            block = (of & 7) + 2
            across = np.where(kinds == 3, (of & 255) + 1, -(-inner[own] >> block))
            down = np.where(kinds == 3, 1, -(-height[own] >> block))
            cache_bits = _read_cache_bits(s, at, limit, own)
            sides, at[own] = _read_pixels(s, at[own], limit[own], across, down, cache_bits)
            for i, k, b, n, side in zip(own.tolist(), kinds.tolist(), block.tolist(), across.tolist(), sides, strict=True):
                if k != 3:
                    undo[i].append((k, b, _planes(side, n)))
                    continue
                packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                undo[i].append((k, int(inner[i]), packed, np.cumsum(_planes(side, n)[0], axis=0) & 255))
                inner[i] = -(-inner[i] >> packed)
    cache_bits = _read_cache_bits(s, at, limit, np.arange(len(streams)))
    grouped = s.peek(at) & 1 == 1
    at += 1
    out: list[np.ndarray | None] = [decode_stream(data) if g else None for data, g in zip(streams, grouped.tolist(), strict=True)]
    rest = np.flatnonzero(~grouped)
    if len(rest):
        INVERTED["colour cache"] += int((cache_bits[rest] > 0).sum())
        found, ends = _read_pixels(s, at[rest], limit[rest], inner[rest], height[rest], cache_bits[rest])
        _ended(ends, limit[rest])
        # without transforms the bytes of a pixel are those of the image
        images = [_planes(p, n) if undo[i] else p.astype(">u4").view(np.uint8).reshape(-1, n, 4) for i, p, n in zip(rest.tolist(), found, inner[rest].tolist(), strict=True)]
        for i, image in zip(rest.tolist(), _undone(images, [undo[i] for i in rest.tolist()]), strict=True):
            out[i] = image.astype(np.uint8, copy=False)
    return out


def _read_cache_bits(s: Streams, at: np.ndarray, limit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Bits of the colour cache of the images that start at ``at[own]``, which moves behind them."""
    look = s.peek(np.minimum(at[own], limit[own]))
    has = look & 1
    at[own] += 1 + 4 * has
    _ended(at[own], limit[own])
    return np.where(has, look >> 1 & 15, 0)


def decode_media(media: list[bytes]) -> list[np.ndarray]:
    """The pixel array (rows, 64) of 8-bit samples of each media value, its images one below another."""
    owner, streams = [], []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            data, at = _chunk(m, at)
            owner.append(i)
            streams.append(data)
    parts: list[list[np.ndarray]] = [[] for _ in media]
    for i, image in zip(owner, decode_streams(streams), strict=True):
        parts[i].append(image[..., 1:3].reshape(len(image), -1))
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]


# --- columns --------------------------------------------------------------------------------------


def to_payload(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


def feature(samples: np.ndarray) -> str:
    """Rows, sum, distinct samples, and one bit for each pair of neighbouring columns: whether the sum rises."""
    columns = samples.sum(axis=0, dtype=np.int64)
    rises = np.packbits(np.diff(columns, prepend=columns[0]) > 0).tobytes().hex()
    distinct = int(np.count_nonzero(np.bincount(samples.ravel(), minlength=256)))
    return f"{len(samples)}:{int(columns.sum())}:{distinct}:{rises}"


#: Payload bytes that are decoded in step: bounds a worker's memory.
BATCH_BYTES = 6_400_000


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("data")
        for i, j in _ranges(pc.binary_length(data).to_pylist()):
            raw = data.slice(i, j - i).to_pylist()
            media = encode_payloads([to_payload(d) for d in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(d) for d in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stored = batch.column("media")
        for i, j in _ranges(batch.column("n_bytes").to_pylist()):
            media = stored.slice(i, j - i).to_pylist()
            images = decode_media(media)
            payloads = [im.tobytes() for im in images]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("n_bytes").slice(i, j - i),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([feature(im) for im in images]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("data"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of the pixels decoded from (doc_id, n_bytes, media)."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)
