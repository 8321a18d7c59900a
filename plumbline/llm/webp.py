"""Media columns: lossless WebP written and read as pixel arrays.

`decode` reads a lossless WebP file: prefix codes (simple and normal, with groups chosen by an
entropy image), back-references, the colour cache, and the inverse of the predictor,
cross-colour, subtract-green and palette transforms. It walks the stream symbol by symbol, except
where one group codes the green channel alone and no colour cache is in use: there it looks up
a code at every bit position at once and then follows the chain of positions, doubling its steps.

`encode` writes 8-bit samples: a palette of the values that occur (several samples a pixel if
there are 16 or fewer), back-references to lines seen before and to runs, and Huffman codes.
A payload is stored as images of width 64, of 1 MiB at most each, one after another.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal media; repeated
rows give equal rows; an empty table gives an empty result; texts of any length are stored
whole; columns named as the new ones give way to them. Bytes that aren't such a file raise ValueError.

The writer uses neither predictor, cross-colour nor subtract-green transforms nor a colour cache: the bytes of a text have no
smooth gradients for them to take out. The reader has them all, for files of other writers; tests reach them.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import table, with_results

WIDTH, PART = 64, 1 << 20
#: Fixed values of the format: the order in which lengths of length codes come, and alphabet sizes (green without colour cache).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
OPAQUE = 0xFF000000


@cache
def _reversed() -> np.ndarray:
    """The 15 bits of each number in the other order."""
    n = np.arange(1 << 15, dtype=np.uint32)
    out = np.zeros_like(n)
    for k in range(15):
        out |= ((n >> k) & 1) << (14 - k)
    return out


@cache
def _near() -> list[tuple[int, int]]:
    """The 120 short distances as steps left and up: by length, then by the step aside, left first."""
    steps = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(steps, key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), -s[0]))


def _extra(prefix: int) -> tuple[int, int]:
    """Least value (counted from 1) and number of extra bits of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1, 0
    bits = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << bits) + 1, bits


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits' number and value for a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, top - 1, v & ((1 << (top - 1)) - 1)


# ---- reading


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        if at + n > 8 * len(self.data):
            raise ValueError("the image ends early")
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


_NO_BITS = np.zeros(1, np.int32)


@cache
def _mirror(bits: int) -> np.ndarray:
    """Numbers of so many bits in the other order."""
    return _reversed()[: 1 << bits] >> (15 - bits)


class _Code:
    """A prefix code as a table over its longest code's bits: symbols and lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """For rising symbols."""
        self.only: int | None = None
        self.rows: list[tuple[int, int]] | None = None
        if len(symbols) == 1:
            self.bits, self.only = 0, int(symbols[0])
            self.symbols, self.lengths = np.array([self.only], np.int32), _NO_BITS
            return
        order = np.argsort(lengths, kind="stable")
        symbols, lengths = symbols[order], lengths[order]
        self.bits = int(lengths[-1])
        spans = 1 << (self.bits - lengths)
        if spans.sum() != 1 << self.bits:
            raise ValueError("the code isn't complete")
        mirror = _mirror(self.bits)
        self.symbols = symbols.astype(np.int32).repeat(spans)[mirror]
        self.lengths = lengths.astype(np.int32).repeat(spans)[mirror]

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        if self.rows is None:  # plain numbers are quicker one by one
            self.rows = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        at = bits.at
        symbol, length = self.rows[(int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)]
        bits.at = at + length
        return symbol


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.read(1):
        two, eight = bits.read(1), bits.read(1)
        found = sorted({bits.read(8 if eight else 1)} | ({bits.read(8)} if two else set()))
        return _Code(np.array(found), np.ones(len(found), np.int64))
    of = [0] * 19
    for k in range(4 + bits.read(4)):
        of[LENGTH_ORDER[k]] = bits.read(3)
    meta = _table(np.array(of, np.int64))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    lengths, before = [], 8
    count = 0
    while count < alphabet and left:
        left -= 1
        n = meta.read(bits)
        if n < 16:
            lengths.append(n)
            count += 1
            before = n or before
        else:
            run = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            lengths += [before if n == 16 else 0] * run
            count += run
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return _table(np.array(lengths, np.int64))


def _table(lengths: np.ndarray) -> _Code:
    used = np.flatnonzero(lengths)
    if not len(used):
        raise ValueError("a code without symbols")
    return _Code(used, lengths[used])


def _read_pixels(bits: _Bits, width: int, height: int, top: bool) -> np.ndarray:
    """The pixels of an entropy-coded image as ARGB numbers; only the top image has code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, block, which, across = 1, 0, None, 0
    if top and bits.read(1):
        block = 2 + bits.read(3)
        across = -(-width >> block)
        which = (_read_pixels(bits, across, -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
    codes = [[_read_code(bits, size + ((1 << cache_bits) if k == 0 and cache_bits else 0)) for k, size in enumerate(ALPHABETS)] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(codes[0][k].only is not None for k in (1, 2, 3)):
        return _read_green(bits, width, width * height, codes[0])
    out = np.zeros(width * height, np.uint32)
    kept = [0] * (1 << cache_bits)
    at, entered, group = 0, 0, codes[0]
    while at < len(out):
        if which is not None:
            group = codes[int(which[(at // width >> block) * across + (at % width >> block)])]
        s = group[0].read(bits)
        if s < 256:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            out[at] = group[3].read(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            low, n = _extra(s - 256)
            length = low + bits.read(n)
            low, n = _extra(group[4].read(bits))
            distance = _distance(low + bits.read(n), width)
            if distance > at or at + length > len(out):
                raise ValueError("a back-reference leaves the image")
            _copy(out, at, distance, length)
            at += length
        else:
            while entered < at:  # pixels enter the cache once it is asked
                colour = int(out[entered])
                kept[(0x1E35A7BD * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
                entered += 1
            out[at] = kept[s - 280]
            at += 1
    return out


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    left, up = _near()[code - 1]
    return max(1, left + up * width)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> None:
    while length > 0:  # what has been copied may be copied again
        n = min(length, distance)
        out[at : at + n] = out[at - distance : at - distance + n]
        at, length, distance = at + n, length - n, distance + n


@cache
def _extras() -> tuple[np.ndarray, np.ndarray]:
    """What a prefix stands for: the least value and the bits that follow."""
    low, n = (np.array(x) for x in zip(*map(_extra, range(40)), strict=True))
    return low, n


def _read_green(bits: _Bits, width: int, total: int, codes: list[_Code]) -> np.ndarray:
    """Pixels of which only green varies: a code is looked up at each bit, then the chain of codes is followed."""
    rest = (codes[3].only << 24) | (codes[1].only << 16) | codes[2].only
    green, far = codes[0], codes[4]
    if green.only is not None and green.only < 256:
        return np.full(total, rest | green.only << 8, np.uint32)
    start = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[start:]
    data = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    words = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).ravel().astype(np.intp)
    symbols = green.symbols[window]
    ends = len(window) - 1
    after = np.arange(len(window), dtype=np.intp) + green.lengths[window]
    jumps = np.flatnonzero(symbols >= 256)
    lengths = distances = None
    if len(jumps):
        if symbols[jumps].max() >= 280:
            raise ValueError("a colour cache code without a cache")
        low, n = _extras()

        def field(at: np.ndarray, n: np.ndarray) -> np.ndarray:
            at = np.minimum(at, ends)
            byte = at >> 3
            wide = words[byte].astype(np.uint64) | (words[np.minimum(byte + 4, len(words) - 1)].astype(np.uint64) << np.uint64(32))
            return ((wide >> (at & 7).astype(np.uint64)) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

        kind = symbols[jumps] - 256
        at = after[jumps].astype(np.int64)
        lengths = low[kind] + field(at, n[kind])
        at += n[kind]
        w = field(at, np.full(len(at), far.bits))
        at += far.lengths[w]
        kind = far.symbols[w]
        distances = low[kind] + field(at, n[kind])
        after[jumps] = at + n[kind]
    np.minimum(after, ends, out=after)
    after[ends] = ends
    steps = [after]
    for _ in range(3):
        steps.append(steps[-1][steps[-1]])
    far_step, at, starts = steps[3], bits.at & 7, []
    for _ in range(-(-total // 8)):
        starts.append(at)
        at = far_step.item(at)
        if at == ends:
            break
    places = np.array(starts, np.intp)[:, None]
    for k in (2, 1, 0):
        places = np.stack((places, steps[k][places]), axis=2).reshape(len(starts), -1)
    places = places.ravel()
    found = symbols[places]
    copies = np.flatnonzero(found >= 256)
    if not len(copies):
        if len(found) < total or places[total - 1] >= ends:
            raise ValueError("the image ends early")
        bits.at = 8 * start + int(after[places[total - 1]])
        return (found[:total].astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    out = np.empty(total, np.uint32)
    at = token = 0
    position = np.searchsorted(jumps, places[copies])
    for c, p in zip(copies.tolist(), position.tolist(), strict=True):
        n = min(c - token, total - at)
        out[at : at + n] = found[token : token + n]
        at += n
        if at >= total:
            token += n
            break
        length, distance = int(lengths[p]), _distance(int(distances[p]), width)
        if distance > at or at + length > total:
            raise ValueError("a back-reference leaves the image")
        _copy(out, at, distance, length)
        at, token = at + length, c + 1
        if at == total:
            break
    if at < total:
        n = total - at
        if len(found) - token < n:
            raise ValueError("the image ends early")
        out[at:] = found[token : token + n]
        token += n
    bits.at = 8 * start + int(after[places[token - 1]])
    return (out << np.uint32(8)) | np.uint32(rest)


def decode(data: bytes) -> np.ndarray:
    """(height, width) ARGB numbers of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = _Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, inner = [], width
    seen: set[int] = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            block = 2 + bits.read(3)
            transforms.append((kind, inner, block, _read_pixels(bits, -(-inner >> block), -(-height >> block), False)))
        elif kind == 3:
            n = bits.read(8) + 1
            colours = _read_pixels(bits, n, 1, False).view(np.uint8).reshape(-1, 4)
            palette = np.zeros(256, np.uint32)
            palette[:n] = np.cumsum(colours, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, inner, pack, palette))
            inner = -(-inner >> pack)
        else:
            transforms.append((kind, inner, 0, None))
    pixels = _read_pixels(bits, inner, height, True).reshape(height, inner)
    for kind, wide, block, values in reversed(transforms):
        if kind == 0:
            pixels = _unpredict(pixels, block, values)
        elif kind == 1:
            pixels = _uncross(pixels, block, values)
        elif kind == 2:
            green = (pixels >> 8) & 0xFF
            pixels = (pixels & np.uint32(0xFF00FF00)) | ((pixels & np.uint32(0x00FF00FF)) + green * np.uint32(0x00010001) & np.uint32(0x00FF00FF))
        else:
            index = (pixels >> 8) & 0xFF
            if block:
                each = 8 >> block
                index = ((index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            pixels = values[index]
    return pixels


def _uncross(pixels: np.ndarray, block: int, values: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    across = -(-width >> block)
    element = values.reshape(-1, across).repeat(1 << block, axis=0)[:height].repeat(1 << block, axis=1)[:, :width]
    signed = lambda x: (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(pixels >> 8), (pixels >> 16).astype(np.int32), pixels.astype(np.int32)
    red = (red + (signed(element) * green >> 5)) & 0xFF
    blue = (blue + (signed(element >> 8) * green >> 5) + (signed(element >> 16) * signed(red) >> 5)) & 0xFF
    return (pixels & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << 16) | blue.astype(np.uint32)


def _unpredict(pixels: np.ndarray, block: int, values: np.ndarray) -> np.ndarray:
    """Adds each pixel's prediction. A row's predictions from above need no order; those from the left are made one by one."""
    height, width = pixels.shape
    across = -(-width >> block)
    modes = ((values >> 8) & 0xF).reshape(-1, across)
    residues = pixels.astype("<u4").view(np.uint8).reshape(height, width, 4).astype(np.int16)
    out = np.zeros_like(residues)
    out[0] = np.cumsum(residues[0], axis=0) & 0xFF
    out[0, :, 3] = (out[0, :, 3] + 0xFF) & 0xFF
    for y in range(1, height):
        row, above, this = residues[y], out[y - 1], out[y]
        this[0] = (row[0] + above[0]) & 0xFF
        mode = modes[y >> block].repeat(1 << block)[:width]
        right = np.concatenate((above[1:], this[:1]))  # the last pixel's upper right is this row's first
        left_up = np.concatenate((above[:1], above[:-1]))
        for m in np.unique(mode[1:]):
            if m in (0, 14, 15, 2, 3, 4, 8, 9):
                guess = {2: above, 3: right, 4: left_up, 8: (left_up + above) >> 1, 9: (above + right) >> 1}.get(int(m))
                guess = np.array([0, 0, 0, 0xFF], np.int16) if guess is None else guess
                chosen = mode == m
                chosen[0] = False
                this[chosen] = ((row + guess) & 0xFF)[chosen]
        for x in range(1, width):
            m = mode[x]
            if m in (1, 5, 6, 7, 10, 11, 12, 13):
                left, up, upper_left, upper_right = this[x - 1], above[x], above[x - 1], right[x]
                if m == 1:
                    guess = left
                elif m == 5:
                    guess = (((left + upper_right) >> 1) + up) >> 1
                elif m == 6:
                    guess = (left + upper_left) >> 1
                elif m == 7:
                    guess = (left + up) >> 1
                elif m == 10:
                    guess = (((left + upper_left) >> 1) + ((up + upper_right) >> 1)) >> 1
                elif m == 11:
                    nearer_left = np.abs(up - upper_left).sum() < np.abs(left - upper_left).sum()
                    guess = left if nearer_left else up
                elif m == 12:
                    guess = np.clip(left + up - upper_left, 0, 255)
                else:
                    mean = (left + up) >> 1
                    change = mean - upper_left
                    guess = np.clip(mean + np.where(change < 0, -(-change >> 1), change >> 1), 0, 255)
                this[x] = (row[x] + guess) & 0xFF
    return out.astype(np.uint8).view("<u4").reshape(height, width)


# ---- writing


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths, 15 at most: rare symbols count for more until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    floor = 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(heap) - 1)
        for node in range(len(heap), len(parent)):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= 15:
            lengths[used] = depth[: len(used)]
            return lengths
        floor = max(2 * floor, sum(weights) >> 14)


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code, first bit lowest, and its length as written: 0 for an only symbol."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes, np.zeros(len(lengths), np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    starts = np.concatenate(([0], np.cumsum(1 << (15 - n))[:-1]))
    codes[order] = _reversed()[starts]
    return codes, lengths


def _header(lengths: np.ndarray) -> list[tuple[int, int]]:
    """A code's description as (value, bits)."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        out = [(1, 1), (int(len(used) == 2), 1)]
        first = int(used[0]) if len(used) else 0
        out += [(0, 1), (first, 1)] if first < 2 else [(1, 1), (first, 8)]
        return out + ([(int(used[1]), 8)] if len(used) == 2 else [])
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    values = lengths.tolist()
    before = 8
    for value, same in itertools.groupby(values):
        run = len(list(same))
        if value == 0:
            while run >= 11:
                n = min(run, 138)
                tokens.append((18, n - 11, 7))
                run -= n
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
        else:
            if value != before:
                tokens.append((value, 0, 0))
                before, run = value, run - 1
            while run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
                run -= n
        tokens += [(value, 0, 0)] * run
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    of = code_lengths(counts)
    while of.max() > 7:  # lengths of length codes have three bits
        counts = np.where(counts > 0, (counts >> 1) + 1, 0)
        of = code_lengths(counts)
    codes, bits = (c.tolist() for c in _codes(of))
    of = of.tolist()
    last = max(k for k in range(19) if of[LENGTH_ORDER[k]])
    out = [(0, 1), (max(last + 1, 4) - 4, 4)]
    out += [(of[LENGTH_ORDER[k]], 3) for k in range(max(last + 1, 4))]
    out.append((0, 1))
    for s, extra, n in tokens:
        out.append((codes[s], bits[s]))
        if n:
            out.append((extra, n))
    return out


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of at most 31 bits written one after another, lowest bit first: each adds to one word or two, and no two numbers share a bit."""
    ends = np.cumsum(widths)
    if not len(ends):
        return b""
    starts = ends - widths
    shifted = (values & ((1 << widths) - 1)) << (starts & 31)
    word, n = starts >> 5, (int(ends[-1]) >> 5) + 2
    words = np.bincount(word, shifted & 0xFFFFFFFF, n) + np.bincount(word + 1, shifted >> 32, n)
    return words.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


def _repeats(data: bytes) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines seen before in the data, and of a run of zeros at its end."""
    seen: dict[bytes, int] = {}
    found, at = [], 0
    body = data.rstrip(b"\0")
    for line in body.split(b"\n"):
        n = len(line)
        if n >= 12:
            earlier = seen.setdefault(line, at)
            if earlier != at and at - earlier <= PART - 121:
                found.append((at, n, at - earlier))
        at += n + 1
    zeros = len(data) - len(body)
    if zeros > 8:
        found.append((len(body) + 1, zeros - 1, 1))
    return found


def encode(payload: bytes) -> bytes:
    """A lossless WebP file of width 64 whose samples are the payload's bytes (64 to PART of them, by 64)."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    used = np.flatnonzero(counts)
    index = np.zeros(256, np.int64)
    index[used] = np.arange(len(used))
    pack = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1 if len(used) <= 16 else 0
    green = index[samples]
    repeats: list[tuple[int, int, int]] = []
    if pack:
        green = (green.reshape(-1, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(axis=1)
    else:
        repeats = _repeats(payload)
    # The palette: greys, each as the change from the one before; green alone varies, alpha changes once.
    changes = np.diff(used, prepend=0)
    tints = code_lengths(np.bincount(changes, minlength=280))
    alphas = code_lengths(np.bincount([255] + [0] * (len(used) - 1), minlength=256))
    fields = [(0x2F, 8), (WIDTH - 1, 14), (len(samples) // WIDTH - 1, 14), (0, 1), (0, 3), (1, 1), (3, 2), (len(used) - 1, 8), (0, 1)]
    only = [(1, 1), (0, 1), (0, 1), (0, 1)]
    fields += _header(tints) + only + only + _header(alphas) + only
    (tint, tint_bits), (alpha, alpha_bits) = _codes(tints), _codes(alphas)
    tint, tint_bits, alpha, alpha_bits = (v.tolist() for v in (tint, tint_bits, alpha, alpha_bits))
    for k, c in enumerate(changes.tolist()):
        a = 0 if k else 255
        fields += [(tint[c], tint_bits[c]), (alpha[a], alpha_bits[a])]
    fields += [(0, 1), (0, 1), (0, 1)]  # no more transforms, no colour cache, one code group
    # The image: literals of green, and copies of at most 4,096 pixels.
    keep = np.ones(len(green), bool)
    copies: list[tuple[int, int, int, int, int, int, int]] = []
    for start, length, distance in repeats:
        keep[start : start + length] = False
        for at in range(start, start + length, 4096):
            p, n, x = _prefix(min(4096, start + length - at))
            copies.append((at, 256 + p, x, n, *_prefix(distance + 120)))
    place = np.flatnonzero(keep)
    symbols = green[place]
    greens = np.bincount(symbols, minlength=280)
    distances = np.zeros(40, np.int64)
    for c in copies:
        greens[c[1]] += 1
        distances[c[4]] += 1
    lengths, far = code_lengths(greens), code_lengths(distances)
    code, bits = _codes(lengths)
    opaque = [(1, 1), (0, 1), (1, 1), (255, 8)]
    fields += _header(lengths) + only + only + opaque + _header(far)
    values, widths = code[symbols], bits[symbols]
    if copies:
        far_code, far_bits = _codes(far)
        parts = np.array([
            ((code[s], bits[s]), (x, n), (far_code[d], far_bits[d]), (dx, dn)) for _, s, x, n, d, dn, dx in copies
        ])
        into = np.searchsorted(place, [c[0] for c in copies])
        values = np.insert(values, np.repeat(into, 4), parts[:, :, 0].ravel())
        widths = np.insert(widths, np.repeat(into, 4), parts[:, :, 1].ravel())
    head = np.array(fields, np.int64)
    body = _packed(np.concatenate((head[:, 0], values)), np.concatenate((head[:, 1], widths)))
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def store(payload: bytes) -> bytes:
    """One image after another, each of PART bytes of the payload at most."""
    return b"".join(encode(payload[at : at + PART]) for at in range(0, len(payload), PART))


def load(media: bytes) -> np.ndarray:
    """The samples of what store() wrote: the green channel of all images."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF":
            raise ValueError("not a row of WebP files")
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(((decode(media[at:end]) >> 8) & 0xFF).astype(np.uint8).ravel())
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def with_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes and media instead of the text."""
    def stored(texts: list[str | None]) -> list[pa.Array]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        media = [store(b + b"\0" * (-len(b) % 64 if b else 64)) for b in raw]
        return [pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())]

    return with_results(docs, stored, "n_bytes long, media binary")


def media_features(rows: DataFrame) -> DataFrame:
    """rows with what the media's samples, read back, show, instead of the media."""

    def shown(media: list[bytes | None]) -> list[pa.Array]:
        out = []
        for m in media:
            samples = load(m or b"")
            data = samples.tobytes()
            counts = np.bincount(samples, minlength=256)
            moments = f"{int((counts * np.arange(256)).sum())}:{int((counts * np.arange(256) ** 2).sum())}"
            feature = f"{WIDTH}x{len(data) // WIDTH}:{int((counts > 0).sum())}:{moments}"
            out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m or b""), hashlib.sha256(m or b"").hexdigest(), feature))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return with_results(rows, shown, added, "media")


def op8_lossless_webp(spark, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
