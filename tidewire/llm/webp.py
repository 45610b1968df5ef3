"""Media columns: lossless WebP.

``decode`` reads any lossless WebP image: prefix codes (simple and normal, also
with several groups of codes), back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms; it returns RGBA samples.

``encode`` stores bytes as the RGBA samples of such an image. It weighs each transform
by the entropy that it leaves, writes the image with the best one and without any, and
keeps the shorter; repeated pixels become back-references, and a colour cache is used
where it saves bits.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import byte_view, fresh, quoted

MAX_SIDE = 1 << 14
#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Neighbours (x, y) that the 120 short distance codes name: nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


#: Predictor modes that are undone a row at a time: the left pixel, or from the row above only.
ROW_MODES = (1, 2, 3, 4, 8, 9)
#: What ``encode`` uses: predictor modes that it tries, the longest code, the largest colour cache (bits), the longest copy, pixels searched together for copies.
TRIED_MODES = (1, 2, 4)
LONGEST_CODE, LARGEST_CACHE, LONGEST_COPY, SEARCHED = 13, 10, 4096, 1 << 18
#: Tables of functions of one number hold those below this.
LOOKED_UP = 1 << 16
#: Images of at most so many pixels are read together, as long as so many are left.
LONGEST_LANE, FEWEST_LANES = 1 << 14, 48
#: Images are read in parts of at most so many, with so many pixels in all.
PART, PART_PIXELS = 4096, 1 << 20
NEAR_STEPS = np.array([*NEAR, (0, 0)])
#: Images of at most so many bytes in all are weighed together.
WEIGHED = 1 << 18


class Corrupt(ValueError):
    """The bytes are no lossless WebP image."""


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, len(data) * 8
        self._word, self._base = int.from_bytes(data[:64], "little"), 0

    def peek(self, n: int) -> int:
        skip = self.at - self._base
        if skip + n > 512 or skip < 0:
            start = self.at >> 3
            self._word, self._base = int.from_bytes(self.data[start : start + 64], "little"), start << 3
            skip = self.at - self._base
        return (self._word >> skip) & ((1 << n) - 1)

    def span(self, start: int, n: int) -> int:
        """n bits from a place on."""
        return int.from_bytes(self.data[start >> 3 : (start + n + 7) >> 3], "little") >> (start & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise Corrupt("the image ends early")
        return value


@cache
def _backwards(n: int) -> np.ndarray:
    """The numbers of n bits, each read from its last bit to its first."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class PrefixCode:
    """A canonical prefix code from its lengths: ``table`` has symbol * 16 + length by the next ``most`` bits."""

    def __init__(self, lengths: np.ndarray):
        symbols = lengths.nonzero()[0]
        if len(symbols) < 2:
            self.most, self.table = 0, symbols << 4 if len(symbols) else np.zeros(1, np.int64)
            return
        packed = lengths[symbols] << 12 | symbols
        packed.sort()
        used, symbols = packed >> 12, packed & 4095
        self.most = int(used[-1])
        share = 1 << (self.most - used)
        if int(share.sum()) != 1 << self.most:
            raise Corrupt("a prefix code is not complete")
        self.table = np.repeat(symbols << 4 | used, share)[_backwards(self.most)]


def _canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of a short alphabet, by code."""
    out, code, before = [], 0, 0
    for n, symbol in sorted((n, symbol) for symbol, n in enumerate(lengths) if n):
        code <<= n - before
        out.append((symbol, n, int(f"{code:0{n}b}"[::-1], 2)))
        code, before = code + 1, n
    return out


def _small_code(lengths: list[int]) -> tuple[list[int], int]:
    """``PrefixCode``'s table of a short alphabet, and the most bits that it looks at."""
    used = _canonical(lengths)
    if len(used) < 2:
        return [used[0][0] << 4 if used else 0], 0
    wide = used[-1][1]
    if sum(1 << wide - n for _, n, _ in used) != 1 << wide:
        raise Corrupt("a prefix code is not complete")
    table = [0] * (1 << wide)
    for symbol, n, code in used:
        table[code :: 1 << n] = [symbol << 4 | n] * (1 << wide - n)
    return table, wide


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Corrupt("a symbol is outside its alphabet")
        lengths[symbols] = 1
        return PrefixCode(lengths)
    count = 4 + bits.read(4)
    widths = bits.read(3 * count)
    of_lengths = [0] * 19
    for i in range(count):
        of_lengths[LENGTH_ORDER[i]] = widths >> 3 * i & 7
    table, wide = _small_code(of_lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    mask, last, out = (1 << wide) - 1, 8, []
    data, at, word, end = bits.data, bits.at, 0, -1
    size = 0
    while size < alphabet and most:
        most -= 1
        if at + 14 > end:
            base, end = at & -8, (at & -8) + 256
            word = int.from_bytes(data[at >> 3 : (at >> 3) + 32], "little")
        ahead = word >> (at - base)
        found = table[ahead & mask]
        symbol, took = found >> 4, found & 15
        at += took
        if symbol < 16:
            out.append(symbol)
            size += 1
            last = symbol or last
            continue
        if symbol == 16:
            run = 3 + (ahead >> took & 3)
            out += [last] * run
            at += 2
        elif symbol == 17:
            run = 3 + (ahead >> took & 7)
            out += [0] * run
            at += 3
        else:
            run = 11 + (ahead >> took & 127)
            out += [0] * run
            at += 7
        size += run
    bits.at = at
    if len(out) > alphabet:
        raise Corrupt("a run of code lengths is too long")
    lengths[: len(out)] = out
    return PrefixCode(lengths)


def _read_codes(bits: Bits, greens: int) -> list[PrefixCode]:
    """The five codes of a group. One whose bits are those of the code before it is that code."""
    out = [_read_code(bits, greens)]
    start = bits.at
    out.append(_read_code(bits, 256))
    size = bits.at - start
    first = bits.span(start, size)
    for _ in range(2):
        if bits.at + size <= bits.size and bits.span(bits.at, size) == first:
            bits.at += size
            out.append(out[1])
        else:
            out.append(_read_code(bits, 256))
    return [*out, _read_code(bits, 40)]


def _count(bits: Bits, prefix: int) -> int:
    """A run length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_groups(bits: Bits, width: int, height: int, main: bool = False) -> tuple[int, np.ndarray | None, int, list[list[PrefixCode]]]:
    """What stands before entropy-coded pixels: bits of the cache, the group of each block if there are several, bits of a block, the groups' codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("the colour cache is too large")
    groups, blocks, block_bits = 1, None, 0
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        across = (width + (1 << block_bits) - 1) >> block_bits
        chosen = _read_image(bits, across, (height + (1 << block_bits) - 1) >> block_bits)
        blocks = chosen[..., 1].astype(int) << 8 | chosen[..., 2]
        groups = int(blocks.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    return cache_bits, blocks, block_bits, [_read_codes(bits, 280 + cache_size) for _ in range(groups)]


def _read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Entropy-coded pixels as ARGB bytes (height, width, 4)."""
    return _read_pixels(bits, width, height, *_read_groups(bits, width, height, main))


def _read_pixels(bits: Bits, width: int, height: int, cache_bits: int, blocks: np.ndarray | None, block_bits: int, codes: list[list[PrefixCode]]) -> np.ndarray:
    read = _pixels(bits, codes[0], width, width * height, cache_bits) if blocks is None else None
    if read is None:
        read = _pixels_in_turn(bits, codes, blocks, block_bits, width, width * height, cache_bits)
    return read.byteswap().view(np.uint8).reshape(height, width, 4)


def _pixels(bits: Bits, codes: list[PrefixCode], width: int, n: int, cache_bits: int, begun: tuple | None = None) -> np.ndarray | None:
    """n pixels (uint32) of one group of codes.

    The width of each code is looked up for every bit at which it might start; following these widths gives the
    true starts, and the symbols are gathered for all pixels at once. None, with nothing read, if a colour
    is asked of the cache before any is there. ``begun``: the bit and the pixel to go on from, symbols and pixels so far, and copies.
    """
    tables, masks = [c.table for c in codes], [np.uint32((1 << c.most) - 1) for c in codes]
    if not any(c.most for c in codes[:4]):
        green, red, blue, alpha = (int(t[0]) >> 4 for t in tables[:4])
        if green > 255:
            raise Corrupt("a back-reference leaves the image")
        return np.full(n, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    took = [(t & 15).astype(np.uint8) for t in tables[:4]]
    took[0] += (32 * (tables[0] > 4095) + 32 * (tables[0] > 4479)).astype(np.uint8)  # 64 and more: cache; 32 and more: copy
    first, at, count = bits.at, bits.at, 0
    symbols, pixels, copies = [], [], []
    if begun:
        at, count, symbols, pixels, copies = begun[0], begun[1], [begun[2]], [begun[3]], begun[4]
    while count < n:
        base, ahead = at & -8, _ahead(bits, at >> 3)
        if at > bits.size:
            raise Corrupt("the image ends early")
        widths = {}
        for code, wide, mask in zip(codes[:4], took, masks, strict=False):
            if id(code) not in widths:
                widths[id(code)] = wide[ahead & mask].tobytes()
        green, red, blue, alpha = (widths[id(code)] for code in codes[:4])
        starts, spot, stop = [], at - base, len(ahead) - 64
        while count < n and spot < stop:
            step = green[spot]
            if step < 32:
                starts.append(spot)
                spot += step
                spot += red[spot]
                spot += blue[spot]
                spot += alpha[spot]
                count += 1
            elif step < 64:
                bits.at = base + spot + step - 32
                length, far = _copy(bits, int(tables[0][int(ahead[spot] & masks[0])]) >> 4, tables[4], int(masks[4]), width)
                if far > count or count + length > n:
                    raise Corrupt("a back-reference leaves the image")
                copies.append((count, length, far))
                count += length
                spot = bits.at - base
            else:
                starts.append(spot)
                spot += step - 64
                count += 1
        at = base + spot
        spots, found = np.array(starts, np.int64), []
        for table, mask in zip(tables[:4], masks, strict=False):
            each = table[ahead[spots] & mask]
            spots += each & 15
            found.append((each >> 4).astype(np.uint32))
            if len(found) == 1:  # nothing but green for the cache; what is read for the rest is not used
                spots[found[0] > 255] = 0
        symbols.append(found[0])
        pixels.append(found[3] << 24 | found[1] << 16 | found[0] << 8 | found[2])
    if at > bits.size:
        raise Corrupt("the image ends early")
    bits.at = at
    symbol, pixel = np.concatenate(symbols), np.concatenate(pixels)
    origin = np.arange(n, dtype=np.int32)
    own = np.ones(n, bool)
    for start, length, far in copies:
        own[start : start + length] = False
        origin[start : start + length] -= far
    out = np.zeros(n, np.uint32)
    out[own] = pixel
    if copies:
        origin = _settled(origin)
    if cache_bits and (cached := symbol > 279).any():
        spots = np.zeros(n, np.uint32)
        spots[own] = np.where(cached, symbol - np.uint32(280), (pixel * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits))
        spots = spots[origin]
        asks = np.zeros(n, bool)
        asks[own] = cached
        order = np.argsort(spots, kind="stable")
        asked = asks[order].nonzero()[0]
        if asked[0] == 0 or (spots[order[asked]] != spots[order[asked - 1]]).any():
            bits.at = first
            return None
        origin[order[asked]] = order[asked - 1]
        origin = _settled(origin)
    return out[origin]


class Lane:
    """An image of one group of codes that is read together with others."""

    def __init__(self, bits: Bits, width: int, n: int, cache_bits: int, codes: list[PrefixCode]):
        self.bits, self.width, self.n, self.cache_bits, self.codes = bits, width, n, cache_bits, codes

    def fits(self) -> bool:
        most = [c.most for c in self.codes]
        return self.n <= LONGEST_LANE and sum(most[:4]) <= 57 and any(most[:4])


def _extra(eight: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_count`` of many, and where each ends; extra bits are read at these places."""
    more = np.maximum(prefix - 2, 0) >> 1
    value = eight[at >> 3].astype(np.int64) >> (at & 7) & ((1 << more) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << more) + value) + 1, at + more


def _pixels_together(lanes: list[Lane]) -> list[np.ndarray | None]:
    """``_pixels`` of many images: a symbol of each at a time, until few are left. None for those with
    which something is wrong: they are to be read alone."""
    datas = [lane.bits.data for lane in lanes]
    edges = np.cumsum([0, *(len(d) for d in datas)])
    raw = np.frombuffer(b"".join(datas) + bytes(1 << 12), np.uint8)
    eight = np.ndarray((len(raw) - 8,), "<i8", raw, strides=(1,))
    distinct = {id(c): c for lane in lanes for c in lane.codes}
    tables = np.concatenate([c.table for c in distinct.values()])
    place = dict(zip(distinct, np.cumsum([0, *(len(c.table) for c in distinct.values())]).tolist(), strict=False))
    base = np.array([[place[id(c)] for c in lane.codes] for lane in lanes]).T.copy()
    mask = np.array([[(1 << c.most) - 1 for c in lane.codes] for lane in lanes]).T.copy()
    wanted, width = np.array([lane.n for lane in lanes]), np.array([lane.width for lane in lanes])
    begin = edges[:-1] * 8
    lane, at = np.arange(len(lanes), dtype=np.int32), begin + [x.bits.at for x in lanes]
    count, steps, turn = np.zeros(len(lanes), np.int64), [], 0
    while True:
        if turn % 16 == 0:
            live = (count < wanted[lane]).nonzero()[0]
            if len(live) < FEWEST_LANES:
                break
            if len(live) < len(lane):
                lane, at, count = lane[live], at[live], count[live]
                base, mask = base[:, live], mask[:, live]
        turn += 1
        ahead = eight[at >> 3] >> (at & 7)
        found = tables[base[0] + (ahead & mask[0])]
        symbol, own = found >> 4, found & 15
        ahead >>= own
        value, took = symbol, own
        for i, shift in ((1, 16), (2, 0), (3, 24)):
            found = tables[base[i] + (ahead & mask[i])]
            one = found & 15
            ahead >>= one
            took = took + one
            value = (value if i > 1 else symbol << 8) | found >> 4 << shift
        held = lane, count.astype(np.int32), symbol.astype(np.int16), value
        grown = np.ones(len(lane), np.int64)
        plain = symbol < 256
        at = at + np.where(plain, took, own)
        if not plain.all() and len(some := ((symbol > 255) & (symbol < 280)).nonzero()[0]):
            length, spot = _extra(eight, at[some], symbol[some] - 256)
            found = tables[base[4][some] + (eight[spot >> 3] >> (spot & 7) & mask[4][some])]
            far, at[some] = _extra(eight, spot + (found & 15), found >> 4)
            name = NEAR_STEPS[np.minimum(far, 121) - 1]
            far = np.where(far > 120, far - 120, np.maximum(1, name[:, 0] + name[:, 1] * width[lane[some]]))
            value[some] = length << 32 | far
            grown[some] = length
        steps.append((*held, (at - begin[lane]).astype(np.int32)))  # what is read beyond an image's end is not used
        count = count + grown
    good = np.ones(len(lanes), bool)
    left = dict(zip(lane[live].tolist(), zip((at[live] - begin[lane[live]]).tolist(), count[live].tolist(), strict=True), strict=True))
    good[list(left)] = False
    lane, count, symbol, value, at = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 5
    longer = {}
    if left:
        mine = (~good[lane]).nonzero()[0]
        mine = mine[np.argsort(lane[mine], kind="stable")]
        cuts = np.searchsorted(lane[mine], [*left, len(lanes)])  # lanes stay in order
        for i, lo, hi in zip(left, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = mine[lo:hi]
            one, what = symbol[part], value[part]
            copied = (one > 255) & (one < 280)
            copies = list(zip(count[part][copied].tolist(), (what[copied] >> 32).tolist(), (what[copied] & 0xFFFFFFFF).tolist(), strict=True))
            if all(far <= place and place + length <= lanes[i].n for place, length, far in copies):
                x = lanes[i]
                try:
                    longer[i] = _pixels(x.bits, x.codes, x.width, x.n, x.cache_bits, (*left[i], one[~copied].astype(np.int64), what[~copied].astype(np.uint32), copies))
                except Corrupt:
                    continue
    valid = (count < wanted[lane]) & good[lane]
    lane, count, symbol, value, at = (x[valid] for x in (lane, count, symbol, value, at))
    good[lane[at > np.diff(edges)[lane] * 8]] = False
    first = np.cumsum(wanted) - wanted
    total = int(wanted.sum())
    spot = first[lane] + count
    copied = (symbol > 255) & (symbol < 280)
    length, far = value[copied] >> 32, value[copied] & 0xFFFFFFFF
    bad = (far > count[copied]) | (count[copied] + length > wanted[lane[copied]])
    good[lane[copied][bad]] = False
    fine = good[lane]
    out, origin = np.zeros(total, np.uint32), np.arange(total, dtype=np.int32)
    plain = fine & (symbol < 256)
    out[spot[plain]] = value[plain]
    fine_copy = fine[copied]
    length, far, start = length[fine_copy], far[fine_copy], spot[copied][fine_copy]
    inside = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    origin[inside] -= np.repeat(far, length).astype(np.int32)
    origin = _settled(origin)
    cached = fine & (symbol > 279)
    if cached.any():
        bits = np.array([x.cache_bits for x in lanes])
        of = np.repeat(np.arange(len(lanes)), wanted)
        mine = (bits > 0)[of].nonzero()[0]
        slots = (out * np.uint32(0x1E35A7BD)) >> (32 - np.maximum(bits, 1)).astype(np.uint32)[of]
        slots[spot[cached]] = symbol[cached].astype(np.int64) - 280
        asks = np.zeros(total, bool)
        asks[spot[cached]] = True
        key = of[mine] << 11 | slots[origin[mine]]
        order = np.argsort(key, kind="stable")
        asked = asks[mine[order]].nonzero()[0]
        before = np.maximum(asked - 1, 0)
        early = (asked == 0) | (key[order[asked]] != key[order[before]])
        good[of[mine[order[asked[early]]]]] = False
        origin[mine[order[asked[~early]]]] = mine[order[before[~early]]]
        origin = _settled(origin)
    out = out[origin]
    return [out[a : a + n] if ok else longer.get(i) for i, (a, n, ok) in enumerate(zip(first.tolist(), wanted.tolist(), good.tolist(), strict=True))]


def _ahead(bits: Bits, start: int) -> np.ndarray:
    """At least 16 bits from each bit on, of up to 4 KB from this byte on."""
    raw = np.frombuffer(bits.data[start : start + 4106].ljust(min(4106, max(0, len(bits.data) - start) + 18), b"\0"), np.uint8).astype(np.uint32)
    whole = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    return (whole[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)


def _settled(origin: np.ndarray) -> np.ndarray:
    """Each place's first origin, where origins may have origins themselves."""
    while True:
        further = origin[origin]
        if (further == origin).all():
            return origin
        origin = further


def _copy(bits: Bits, symbol: int, distances, mask: int, width: int) -> tuple[int, int]:
    """Length and distance of a back-reference whose first symbol is read."""
    length = _count(bits, symbol - 256)
    found = int(distances[bits.peek(15) & mask])
    bits.at += found & 15
    far = _count(bits, found >> 4)
    return length, far - 120 if far > 120 else max(1, NEAR[far - 1][0] + NEAR[far - 1][1] * width)


def _pixels_in_turn(bits: Bits, codes: list[list[PrefixCode]], blocks: np.ndarray | None, block_bits: int, width: int, n: int, cache_bits: int) -> np.ndarray:
    """n pixels (uint32), one after the other: for several groups of codes."""
    out = array("I")
    colours, cached = [0] * (1 << cache_bits), 0  # cached: pixels that the cache has taken in
    groups = [[(c.table.tolist(), (1 << c.most) - 1) for c in group] for group in codes]
    rows = blocks.tolist() if blocks is not None else None
    group = groups[0]

    def following(k: int) -> int:
        table, mask = group[k]
        found = table[bits.peek(15) & mask]
        bits.at += found & 15
        return found >> 4

    while len(out) < n:
        if rows is not None:
            y, x = divmod(len(out), width)
            group = groups[rows[y >> block_bits][x >> block_bits]]
        symbol = following(0)
        if symbol < 256:
            red, blue, alpha = following(1), following(2), following(3)
            out.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 280:
            length, far = _copy(bits, symbol, *group[4], width)
            if far > len(out) or len(out) + length > n:
                raise Corrupt("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            while cached < len(out):
                colours[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(colours[symbol - 280])
        if bits.at > bits.size:
            raise Corrupt("the image ends early")
    return np.frombuffer(out, np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left, top, corner, right) -> np.ndarray:
    """What mode 0 to 13 foretells from the neighbours (int arrays of four channels)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        gap = mean - corner
        return np.clip(mean + np.where(gap < 0, -(-gap >> 1), gap >> 1), 0, 255)
    return np.array([255, 0, 0, 0])


def _undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width, _ = image.shape
    out = image.astype(np.int64)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (row[0] + above[0]) & 255
        kinds = modes[y >> bits]
        if (kinds == kinds[0]).all() and kinds[0] in ROW_MODES:
            if kinds[0] == 1:
                out[y] = np.cumsum(row, axis=0) & 255
            else:
                row[1:] = (row[1:] + _predict(int(kinds[0]), None, above[1:], above[:-1], np.concatenate((above[2:], row[:1])))) & 255
            continue
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + _predict(int(kinds[x >> bits]), row[x - 1], above[x], above[x - 1], right)) & 255
    return out.astype(np.uint8)


def _undo_cross_colour(image: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    height, width, _ = image.shape
    factor = factors.view(np.int8).astype(np.int64).repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width]
    signed = lambda x: x.astype(np.uint8).view(np.int8).astype(np.int64)
    out = image.astype(np.int64)
    green = signed(image[..., 2])
    red = (out[..., 1] + (factor[..., 3] * green >> 5)) & 255
    out[..., 1] = red
    out[..., 3] = (out[..., 3] + (factor[..., 2] * green >> 5) + (factor[..., 1] * signed(red) >> 5)) & 255
    return out.astype(np.uint8)


def _undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    packed = _packed_bits(len(palette))
    wide = 8 >> packed
    index = image[..., 2].astype(np.int64)
    index = (index[..., None] >> (wide * np.arange(1 << packed))) & ((1 << wide) - 1)
    index = index.reshape(image.shape[0], -1)[:, :width]
    whole = np.zeros((256, 4), np.uint8)
    whole[: len(palette)] = palette
    return whole[index]


def _packed_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _begin(media: bytes) -> tuple[Bits, list[tuple], int, int]:
    """The bits behind the transforms, these, and the size of the image that follows."""
    if len(media) < 21 or media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L" or media[20] != 0x2F:
        raise Corrupt("no lossless WebP image")
    size = struct.unpack("<I", media[16:20])[0]
    bits = Bits(media[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Corrupt("a transform is there twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across, down = (now + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            undo.append((kind, _read_image(bits, across, down), block))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = np.cumsum(_read_image(bits, colours, 1)[0].astype(np.int64), axis=0).astype(np.uint8)
            undo.append((kind, table, now))
            now = (now + (1 << _packed_bits(colours)) - 1) >> _packed_bits(colours)
        else:
            undo.append((kind, None, 0))
    return bits, undo, now, height


def decode(media: bytes) -> np.ndarray:
    """The RGBA samples (height, width, 4) of a lossless WebP image; ``Corrupt`` if it is none."""
    bits, undo, width, height = _begin(media)
    return _undone(_read_image(bits, width, height, main=True), undo)


def decode_all(media: list[bytes]) -> list[np.ndarray | None]:
    """``decode`` of each, None for those that are no lossless WebP image; pixels of many are read together."""
    out: list[np.ndarray | None] = [None] * len(media)
    lanes, rest = [], []
    for i, blob in enumerate(media):
        try:
            bits, undo, width, height = _begin(blob)
            cache_bits, blocks, block_bits, codes = _read_groups(bits, width, height, main=True)
            lane = Lane(bits, width, width * height, cache_bits, codes[0])
            if blocks is None and lane.fits():
                lanes.append((lane, i, undo, height))
            else:
                out[i] = _undone(_read_pixels(bits, width, height, cache_bits, blocks, block_bits, codes), undo)
        except Corrupt:
            continue
    for (lane, i, undo, height), pixels in zip(lanes, _pixels_together([x[0] for x in lanes]) if lanes else [], strict=True):
        if pixels is None:
            rest.append(i)
        else:
            out[i] = _undone(pixels.byteswap().view(np.uint8).reshape(height, lane.width, 4), undo)
    for i in rest:
        try:
            out[i] = decode(media[i])
        except Corrupt:
            continue
    return out


def _undone(image: np.ndarray, undo: list[tuple]) -> np.ndarray:
    """RGBA samples from ARGB pixels, transforms undone."""
    for kind, given, number in reversed(undo):
        if kind == PREDICTOR:
            image = _undo_predictor(image, given[..., 2], number)
        elif kind == CROSS_COLOUR:
            image = _undo_cross_colour(image, given, number)
        elif kind == PALETTE:
            image = _undo_palette(image, given, number)
        else:
            image = image.copy()
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
    return image[..., [1, 2, 3, 0]]


class Out:
    """Numbers as bits, the lowest first: single ones gathered in a long number, many as arrays."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.few, self.bits = 0, 0

    def put(self, value: int, width: int) -> None:
        self.few |= value << self.bits
        self.bits += width

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Each has at most 57 bits, so that it lies in two words at most."""
        self.parts += [(self.few, self.bits), (values, widths.astype(np.int64))]
        self.few, self.bits = 0, 0


def _joined(outs: list[Out]) -> list[bytes]:
    """The bytes of each."""
    totals = [out.bits + sum([widths if isinstance(widths, int) else int(widths.sum()) for _, widths in out.parts]) for out in outs]
    edges = np.cumsum([0, *(total // 64 + 3 for total in totals)]).tolist()
    words = np.zeros(edges[-1], "<u8")
    octets, all_values, all_starts = words.view(np.uint8), [], []
    for out, word in zip(outs, edges, strict=False):
        at = word * 64
        for values, widths in [*out.parts, (out.few, out.bits)]:
            if isinstance(values, int):
                raw = (values << (at & 7)).to_bytes((widths + 15) // 8, "little")
                octets[at >> 3 : (at >> 3) + len(raw)] |= np.frombuffer(raw, np.uint8)
                at += widths
            else:
                ends = widths.cumsum() + at
                all_values.append(values)
                all_starts.append(ends - widths)
                at = int(ends[-1])
    if all_values:
        values, starts = np.concatenate(all_values), np.concatenate(all_starts)
        shift = (starts & 63).view(np.uint64)
        np.bitwise_or.at(words, starts >> 6, values << shift)
        np.bitwise_or.at(words, (starts >> 6) + 1, (values >> np.uint64(1)) >> (np.uint64(63) - shift))
    return [octets[8 * word : 8 * word + -(-total // 8)].tobytes() for word, total in zip(edges, totals, strict=False)]


def _code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are evened out until no code is longer than ``longest``."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    n = len(used)
    if n < 2:
        return lengths
    leaves = counts[used].tolist()
    while True:
        weight, parent = leaves + [0] * (n - 1), [0] * (2 * n - 1)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                one, leaf = leaf, leaf + 1
            else:
                one, node = node, node + 1
            if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                two, leaf = leaf, leaf + 1
            else:
                two, node = node, node + 1
            parent[one] = parent[two] = new
            weight[new] = weight[one] + weight[two]
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if depth[0] <= longest:
            lengths[used] = depth[:n]
            return lengths
        leaves = [x // 2 + 1 for x in leaves]


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of these lengths, first bit lowest."""
    out = np.zeros(len(lengths), np.uint64)
    symbols = lengths.nonzero()[0]
    if len(symbols):
        packed = lengths[symbols] << 12 | symbols
        packed.sort()
        used = packed >> 12
        most = int(used[-1])
        share = 1 << (most - used)
        out[packed & 4095] = _backwards(most)[share.cumsum() - share]
    return out


SINGLE = [(value, 0, 0) for value in range(16)]


def _runs(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra bits, their number): runs of zeros and repeats shortened."""
    starts = [0, *((lengths[1:] != lengths[:-1]).nonzero()[0] + 1).tolist()]
    out = []
    for value, lo, hi in zip(lengths[starts].tolist(), starts, [*starts[1:], len(lengths)], strict=True):
        run = hi - lo
        if run == 1:
            out.append(SINGLE[value])
            continue
        if value:
            out.append(SINGLE[value])
            run -= 1
        while run >= 3:
            n = min(run, 6 if value else 138)
            out.append((16, n - 3, 2) if value else (17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            run -= n
        out += [SINGLE[value]] * run
    return out


def _write_code(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for these counts; gives its codes and their lengths by symbol."""
    used = np.flatnonzero(counts)
    if len(used) < 3 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for symbol in symbols:
            out.put(symbol, 8)
        lengths = np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            lengths[used] = 1
        return _codes(lengths), lengths.astype(np.uint64)
    lengths = _code_lengths(counts, LONGEST_CODE)
    runs = _runs(lengths)
    of_runs = np.bincount([r[0] for r in runs], minlength=19)
    if len(of_runs.nonzero()[0]) == 1:
        of_runs[0 if of_runs[0] == 0 else 1] = 1
    wide = _code_lengths(of_runs, 7).tolist()
    names = {symbol: code for symbol, _, code in _canonical(wide)}
    stored = max(i for i, symbol in enumerate(LENGTH_ORDER) if wide[symbol] or i == 3) + 1
    out.put(0, 1)
    out.put(stored - 4, 4)
    value, at = 0, 0
    for symbol in LENGTH_ORDER[:stored]:
        value |= wide[symbol] << at
        at += 3
    at += 1
    for symbol, extra, n in runs:
        value |= (names[symbol] | extra << wide[symbol]) << at
        at += wide[symbol] + n
    out.put(value, at)
    return _codes(lengths), lengths.astype(np.uint64)


def _copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches of two or more pixels that occurred before, from left to right."""
    out = []
    for lo in range(0, len(pixels), SEARCHED):
        part = pixels[lo : lo + SEARCHED]
        if len(part) < 3:
            continue
        pairs = part[:-1].astype(np.uint64) << np.uint64(32) | part[1:]
        order = np.argsort(pairs, kind="stable")
        ordered = pairs[order]
        again = np.flatnonzero(ordered[1:] == ordered[:-1])
        if not len(again):
            continue
        spots, before = order[again + 1], order[again]
        by_spot = np.argsort(spots)
        values, n, free = part.tolist(), len(part), 0
        for spot, first in zip(spots[by_spot].tolist(), before[by_spot].tolist(), strict=True):
            if spot < free:
                continue
            free, end = spot + 2, min(n, spot + LONGEST_COPY)
            far = spot - first
            while free < end and values[free] == values[free - far]:
                free += 1
            out.append((lo + spot, free - spot, far))
    return out


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances."""
    if len(values) and values.max() < LOOKED_UP:
        symbol, extra, top = _prefixes()
        return symbol[values], extra[values], top[values]
    return _prefix_of(values)


@cache
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix_of`` all values below LOOKED_UP; none is asked of 0."""
    return _prefix_of(np.maximum(np.arange(LOOKED_UP), 1))


def _prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    less = values - 1
    top = np.maximum(np.frexp(np.maximum(less, 1).astype(float))[1] - 2, 0)  # bits below the two highest
    top = np.where(less < 4, 0, top)
    symbol = np.where(less < 4, less, 2 * top + (less >> top))
    return symbol, less & ((1 << top) - 1), top


@cache
def _near_names(width: int) -> np.ndarray:
    """The short code of each small distance in an image of this width, else 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for name in range(len(NEAR), 0, -1):
        far = NEAR[name - 1][0] + NEAR[name - 1][1] * width
        if far > 0:
            out[far] = name
    return out


#: Where the symbols of each channel of a pixel (alpha, red, green, blue) are counted.
CHANNELS = np.array([0, 256, 512, 768])


@cache
def _self_bits() -> np.ndarray:
    """x * log2(x) of all x below LOOKED_UP."""
    x = np.arange(LOOKED_UP, dtype=float)
    return x * np.log2(np.maximum(x, 1))


def _costs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Bits that symbols so frequent take, of several codes with so many in all, and about five for each that has to be named; a row for each image."""
    return _spent(totals) - _spent(counts) + 5 * np.count_nonzero(counts, axis=1)


def _spent(counts: np.ndarray) -> np.ndarray:
    """The sum of x * log2(x) of each row, whatever rows are beside it."""
    if counts.max() < LOOKED_UP:
        return _self_bits()[counts].sum(axis=1)
    return np.array([(_self_bits()[row] if row.max() < LOOKED_UP else row * np.log2(np.maximum(row, 1))).sum() for row in counts])


def _bits_left(image: np.ndarray) -> float:
    """About how many bits the literals of an image take."""
    pixels = image.reshape(-1, 4)
    return float(_costs(np.bincount((pixels + CHANNELS).reshape(-1), minlength=1024)[None], np.full((1, 4), len(pixels)))[0])


#: Where distances, the first of the other channels and green are counted, and all that is counted of an image.
OTHERS, GREEN = 40, 808
COUNTED = GREEN + 280 + (1 << LARGEST_CACHE)


def _write_images(outs: list[Out], images: list[np.ndarray], main: bool = False) -> None:
    """Entropy-coded pixels (height, width, 4), ARGB, of each image: copies, cache hits and literals with one group of codes."""
    sizes = np.array([x.shape[0] * x.shape[1] for x in images])
    edges, widths_ = np.cumsum([0, *sizes]), np.array([x.shape[1] for x in images])
    bytes_ = np.concatenate([np.ascontiguousarray(x).reshape(-1, 4) for x in images])
    pixels = bytes_.view(">u4").reshape(-1).astype(np.uint32)
    n, of = len(pixels), np.repeat(np.arange(len(images)), sizes)
    found = [_copies(pixels[lo:hi]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    copies = np.array([c for part in found for c in part], np.int64).reshape(-1, 3)
    copies[:, 0] += np.repeat(edges[:-1], [len(part) for part in found])
    inside = np.bincount(copies[:, 0] + 1, minlength=n + 1) - np.bincount(copies[:, 0] + copies[:, 1], minlength=n + 1)
    starts = (inside.cumsum()[:n] == 0).nonzero()[0]
    of_copy = np.searchsorted(starts, copies[:, 0])
    literal = np.ones(len(starts), bool)
    literal[of_copy] = False
    row = of[starts] * COUNTED
    length, length_extra, length_bits = _prefix(copies[:, 1])
    far, named = copies[:, 2], np.zeros(len(copies), np.int64)
    for width in set(widths_.tolist()):
        near = _near_names(width)
        short = (far < len(near)) & (widths_[of[copies[:, 0]]] == width)
        named[short] = near[far[short]]
    distance, distance_extra, distance_bits = _prefix(np.where(named > 0, named, far + 120))
    channels = bytes_[starts]
    cache_bits = [min(LARGEST_CACHE, max(1, x.bit_length() - 5)) for x in sizes.tolist()]
    spot = (pixels * np.uint32(0x1E35A7BD)) >> np.array([32 - x for x in cache_bits], np.uint32)[of]
    key = of << LARGEST_CACHE | spot
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit = hit[starts] & literal
    del key, order, same, inside
    symbol = channels[:, 2].astype(np.int64)
    symbol[of_copy] = 256 + length
    far_rows = row[of_copy]

    def counted(cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = literal & ~cached
        now = np.where(cached, 280 + spot[starts].astype(np.int64), symbol)
        counts = np.bincount(far_rows + distance, minlength=len(images) * COUNTED)
        for lo in range(0, len(starts), SEARCHED):
            part = slice(lo, lo + SEARCHED)
            others = (row[part, None] + channels[part][:, [1, 3, 0]] + [OTHERS, OTHERS + 256, OTHERS + 512])[plain[part]]
            counts += np.bincount(np.concatenate((others.reshape(-1), row[part] + GREEN + now[part])), minlength=len(counts))
        counts = counts.reshape(-1, COUNTED)
        each = [np.bincount(of[starts[x]], minlength=len(images)) for x in (plain, of_copy, slice(None))]
        return _costs(counts, np.stack([*each[:1] * 3, *each[1:]], axis=1)), counts, now

    cost, counts, now = counted(np.zeros(len(starts), bool))
    cached = np.bincount(of[starts[hit]], minlength=len(images)) > 0
    if cached.any():
        other, with_cache, now = counted(hit)
        cached &= other < cost
        counts = np.where(cached[:, None], with_cache, counts)
        hit &= cached[of[starts]]
        now = np.where(hit, now, symbol)
    codes, lengths = np.zeros((len(images), COUNTED), np.uint64), np.zeros((len(images), COUNTED), np.uint64)
    for i, out in enumerate(outs):
        greens = 280 + (1 << cache_bits[i] if cached[i] else 0)
        out.put(int(cached[i]), 1)
        if cached[i]:
            out.put(cache_bits[i], 4)
        if main:
            out.put(0, 1)
        counts_, code, length_ = counts[i], codes[i], lengths[i]
        # bytes of a text are spread alike in all other channels; one code serves as well
        one = counts_[OTHERS : OTHERS + 256] + counts_[OTHERS + 256 : OTHERS + 512] + counts_[OTHERS + 512 : GREEN]
        code[GREEN : GREEN + greens], length_[GREEN : GREEN + greens] = _write_code(out, counts_[GREEN : GREEN + greens])
        few, bits = out.few, out.bits
        code[OTHERS : OTHERS + 256], length_[OTHERS : OTHERS + 256] = _write_code(out, one)
        written = out.few >> bits, out.bits - bits
        for at in (OTHERS + 256, OTHERS + 512):
            out.put(*written)
            code[at : at + 256], length_[at : at + 256] = code[OTHERS : OTHERS + 256], length_[OTHERS : OTHERS + 256]
        code[:OTHERS], length_[:OTHERS] = _write_code(out, counts_[:OTHERS])
    codes, lengths = codes.reshape(-1), lengths.reshape(-1)
    now += row + GREEN
    values, widths = codes[now], lengths[now]
    plain = (literal & ~hit).nonzero()[0]
    value, wide = values[plain], widths[plain]
    for channel, at in ((1, OTHERS), (3, OTHERS + 256), (0, OTHERS + 512)):
        part = row[plain] + at + channels[plain, channel]
        value |= codes[part] << wide
        wide += lengths[part]
    values[plain], widths[plain] = value, wide
    far_rows = far_rows + distance
    for value, more in ((length_extra, length_bits), (codes[far_rows], lengths[far_rows]), (distance_extra, distance_bits)):
        values[of_copy] |= value.astype(np.uint64) << widths[of_copy]
        widths[of_copy] += more.astype(np.uint64)
    cuts = np.searchsorted(starts, edges).tolist()
    for out, lo, hi in zip(outs, cuts, cuts[1:], strict=False):
        out.put_all(values[lo:hi], widths[lo:hi])


class Stack:
    """Images of one width, one below the other: what holds for each is found for all at once."""

    def __init__(self, images: list[np.ndarray]):
        heights = [len(x) for x in images]
        self.image = np.concatenate(images) if len(images) > 1 else images[0]
        self.edges = np.cumsum([0, *heights])
        self.tops = self.edges[:-1]
        self.of_row = np.repeat(np.arange(len(images)), heights)
        self.pixels = [h * self.image.shape[1] for h in heights]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums for each image of numbers for each pixel."""
        return np.add.reduceat(values.sum(axis=1, dtype=np.int64), self.tops)

    def bits_left(self, image: np.ndarray) -> list[float]:
        """``_bits_left`` of each image."""
        code = image.reshape(len(image), -1, 4) + (CHANNELS + 1024 * self.of_row[:, None])[:, None]
        counts = np.bincount(code.reshape(-1), minlength=1024 * len(self.tops)).reshape(-1, 1024)
        return _costs(counts, np.repeat(np.array(self.pixels), 4).reshape(-1, 4)).tolist()

    def with_predictor(self) -> tuple[list[int], np.ndarray]:
        """The mode of ``TRIED_MODES`` with the smallest residuals of each image, and those."""
        now = self.image.astype(np.int16)
        above = np.concatenate((now[:1], now[:-1]))
        out = np.empty_like(self.image)
        out[:, 0] = now[:, 0] - above[:, 0]
        right = np.concatenate((above[:, 2:], now[:, :1]), axis=1)
        rests, sizes = [], []
        for mode in TRIED_MODES:
            rest = (now[:, 1:] - _predict(mode, now[:, :-1], above[:, 1:], above[:, :-1], right)).astype(np.uint8)
            size = np.abs(rest.view(np.int8).astype(np.int16)).reshape(len(rest), -1).sum(axis=1, dtype=np.int64)
            size[self.tops] = 0  # first rows are foretold from the left
            rests.append(rest)
            sizes.append(np.add.reduceat(size, self.tops))
        best = np.argmin(sizes, axis=0)
        for i, rest in enumerate(rests):
            if (best == i).all():
                out[:, 1:] = rest
            else:
                mine = (best == i)[self.of_row]
                out[mine, 1:] = rest[mine]
        tops = now[self.tops]
        out[self.tops, 1:] = tops[:, 1:] - tops[:, :-1]
        out[self.tops, 0] = tops[:, 0] - [255, 0, 0, 0]
        return [TRIED_MODES[i] for i in best.tolist()], out

    def with_cross_colour(self) -> tuple[list[np.ndarray], np.ndarray]:
        """One set of factors (as an ARGB pixel) by least squares for each image, and what they leave."""
        green, red, blue = (self.image[..., c].view(np.int8).astype(np.int32) for c in (2, 1, 3))
        whole = np.maximum(1, self.sums(green * green))
        to_red, to_blue = (np.clip(np.round(32 * self.sums(x * green) / whole), -128, 127).astype(np.int32) for x in (red, blue))
        out = self.image.copy()
        out[..., 1] = red - (to_red[self.of_row][:, None] * green >> 5)
        out[..., 3] = blue - (to_blue[self.of_row][:, None] * green >> 5)
        return [np.array([255, 0, b & 255, r & 255], np.uint8) for r, b in zip(to_red.tolist(), to_blue.tolist(), strict=True)], out

    def without_green(self) -> np.ndarray:
        out = self.image.copy()
        out[..., 1] -= self.image[..., 2]
        out[..., 3] -= self.image[..., 2]
        return out

    def colours(self) -> np.ndarray:
        """How many colours each image has."""
        pixels = self.image.view(">u4")[..., 0].astype(np.uint64) | self.of_row.astype(np.uint64)[:, None] << np.uint64(32)
        pixels = np.sort(pixels.reshape(-1))
        new = np.concatenate(([True], pixels[1:] != pixels[:-1]))
        return np.bincount((pixels[new] >> np.uint64(32)).astype(np.int64), minlength=len(self.tops))

    def media(self) -> list[bytes]:
        """Each image's file: without a transform, or with the one that leaves the fewest bits, if that is shorter."""
        modes, predicted = self.with_predictor()
        factors, crossed = self.with_cross_colour()
        less = self.without_green()
        plain, *left = (self.bits_left(x) for x in (self.image, predicted, crossed, less))
        colours = self.colours().tolist()
        images = [self.image[lo:hi] for lo, hi in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)]
        out, better = _files([(image,) for image in images]), {}
        for i, image in enumerate(images):
            lo, hi = self.edges[i], self.edges[i + 1]
            plans = [
                (left[0][i] + 50, PREDICTOR, modes[i], predicted[lo:hi]),
                (left[1][i] + 60, CROSS_COLOUR, factors[i], crossed[lo:hi]),
                (left[2][i] + 3, SUBTRACT_GREEN, None, less[lo:hi]),
            ]
            if colours[i] <= 256:
                found = _with_palette(image)
                plans.append((_bits_left(found[1]) + _bits_left(found[0]) + 40, PALETTE, *found))
            cost, *plan = min(plans, key=lambda p: p[:2])
            if cost < plain[i]:
                better[i] = (image, *plan)
        for i, media in zip(better, _files(list(better.values())), strict=True):
            out[i] = min(media, out[i], key=len)
        return out


def _with_palette(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The colours (at most 256), and the image of their packed numbers."""
    pixels = image.view(">u4").reshape(-1).astype(np.uint32)
    ordered = np.sort(pixels)
    colours = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
    index = np.searchsorted(colours, pixels)
    packed = _packed_bits(len(colours))
    height, width = image.shape[:2]
    across = -(-width >> packed) if packed else width
    wide = np.zeros((height, across << packed), np.int64)
    wide[:, :width] = index.reshape(height, width)
    out = np.zeros((height, across, 4), np.uint8)
    out[..., 0] = 255
    out[..., 2] = (wide.reshape(height, across, -1) << ((8 >> packed) * np.arange(1 << packed))).sum(-1)
    return colours.astype(">u4").view(np.uint8).reshape(-1, 4), out


def _file(image: np.ndarray, kind: int | None = None, given: np.ndarray | int | None = None, rest: np.ndarray | None = None) -> bytes:
    """The image with one transform, or none."""
    return _files([(image, kind, given, rest)])[0]


def _files(plans: list[tuple]) -> list[bytes]:
    """``_file`` of each."""
    outs, mains = [], []
    for image, kind, given, rest in ((*plan, None, None, None)[:4] for plan in plans):
        height, width = image.shape[:2]
        out = Out()
        out.put(width - 1 | height - 1 << 14 | 1 << 28, 32)
        if kind is not None:
            out.put(1 | kind << 1, 3)
            if kind in (PREDICTOR, CROSS_COLOUR):  # blocks of 512 pixels a side, all alike
                out.put(7, 3)
                pixel = np.array([255, 0, given, 0], np.uint8) if kind == PREDICTOR else given
                _write_images([out], [np.broadcast_to(pixel, (-(-height >> 9), -(-width >> 9), 4))])
            elif kind == PALETTE:
                out.put(len(given) - 1, 8)
                _write_images([out], [np.diff(given.astype(np.int16), axis=0, prepend=np.zeros((1, 4), np.int16)).astype(np.uint8)[None]])
        out.put(0, 1)
        outs.append(out)
        mains.append(image if rest is None else rest)
    if outs:
        _write_images(outs, mains, main=True)
    files = []
    for made in _joined(outs):
        raw = b"\x2f" + made
        padded = raw + b"\0" * (len(raw) & 1)
        files.append(b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + padded)
    return files


def _image(payload: np.ndarray) -> np.ndarray:
    """The payload as ARGB pixels, zeros behind it."""
    rows = len(payload) // 64
    if rows > MAX_SIDE * MAX_SIDE // 16:
        raise ValueError("a payload of more than 1 GiB does not fit one image")
    columns = -(-rows // MAX_SIDE)
    height = -(-rows // columns)
    width = 16 * columns
    samples = payload
    if width * height * 4 != len(payload):
        samples = np.zeros(width * height * 4, np.uint8)
        samples[: len(payload)] = payload
    return np.ascontiguousarray(samples.reshape(height, width, 4)[..., [3, 0, 1, 2]])


def encode(payload: np.ndarray) -> bytes:
    """A lossless WebP image whose RGBA samples begin with the payload (a positive multiple of 64 bytes); zeros follow."""
    return Stack([_image(payload)]).media()[0]


def encode_all(payloads: list[np.ndarray]) -> list[bytes]:
    """``encode`` of each; neighbours of one width, WEIGHED bytes in all, are weighed together."""
    out, held, size = [], [], 0
    for payload in payloads:
        image = _image(payload)
        if held and (size + image.size > WEIGHED or image.shape[1] != held[0].shape[1]):
            out += Stack(held).media()
            held, size = [], 0
        held.append(image)
        size += image.size
    return out + (Stack(held).media() if held else [])


def encode_media(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_bytes``, ``payload_bytes`` and ``media``: each text's UTF-8 bytes
    (null: none), with zeros up to a positive multiple of 64, as a lossless WebP image.

    Equal texts give equal media. A text of more than 1 GiB does not fit one image and is an error.
    While one image is written, about 32 bytes of memory are held for each byte of its text.
    """
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    keep = [c for c in keep if c not in {f.name for f in made}]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_view(batch.column(len(keep)))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, payloads = [], []
                for i in range(lo, lo + part.num_rows):
                    text = data[offsets[i] : offsets[i + 1]]
                    payload = np.zeros(max(1, -(-len(text) // 64)) * 64, np.uint8)
                    payload[: len(text)] = text
                    sizes.append(len(text))
                    payloads.append(payload)
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(sizes, pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(encode_all(payloads), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in made)])

    picked = [F.col(quoted(c)) for c in keep] + [F.col(quoted(text_col)).cast("string").alias(fresh("_text_", docs))]
    return docs.select(*picked).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + made))


def decode_media(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns ``keep``, ``width``, ``height`` and ``pixels`` (RGBA, row by row) and ``feature``.

    ``feature`` is an average hash: a hex digit for four of 64 equal runs of the samples, a
    bit each, set where the run's mean is above the mean of all. Null or broken media
    give nulls.
    """
    made = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType())]
    keep = [c for c in keep if c not in {f.name for f in made}]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(keep)):
                rows = []
                for image in decode_all([blob or b"" for blob in part.column(len(keep)).to_pylist()]):
                    if image is None:
                        rows.append((None,) * 4)
                        continue
                    flat = np.ascontiguousarray(image).reshape(-1)
                    rows.append((image.shape[1], image.shape[0], flat.tobytes(), average_hash(flat)))
                columns = [part.column(i) for i in range(len(keep))]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in made)])

    picked = [F.col(quoted(c)) for c in keep] + [F.col(quoted(media_col)).alias(fresh("_media_", media))]
    return media.select(*picked).mapInArrow(run, T.StructType([media.schema[c] for c in keep] + made))


def _parts(batch: pa.RecordBatch, media: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts by PART and PART_PIXELS, sizes as the images' beginnings say."""
    lo, pixels = 0, 0
    for i, blob in enumerate(batch.column(media)):
        sides = int.from_bytes((blob.as_py() or b"")[21:25], "little")
        size = ((sides & 0x3FFF) + 1) * ((sides >> 14 & 0x3FFF) + 1)
        if i > lo and (i - lo == PART or pixels + size > PART_PIXELS):
            yield batch.slice(lo, i - lo)
            lo, pixels = i, 0
        pixels += size
    if lo < batch.num_rows:
        yield batch.slice(lo)


def average_hash(samples: np.ndarray) -> str:
    usable = len(samples) // 64 * 64
    if not usable:
        return "0" * 16
    sums = samples[:usable].reshape(64, -1).sum(1, dtype=np.int64)
    return np.packbits(sums * 64 > sums.sum()).tobytes().hex()
