"""Another encoder writes everything the decoder must undo; the one in webp.py is tested by what it chooses."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import webp
from tidewire.llm.webp import Corrupt, average_hash, decode, decode_media, encode, encode_media


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, symbol, codes):
        value, n = codes[symbol]
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def file(self):
        raw = b"\x2f" + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        raw += b"\0" * (len(raw) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw


def lengths_for(used, alphabet, stairs=12):
    """Lengths of an uneven complete code: 1, 2, 3, ... for at most ``stairs`` symbols, else of one or two lengths."""
    used = sorted(used)
    out = [0] * alphabet
    if len(used) <= stairs:
        for i, s in enumerate(used):
            out[s] = min(i + 1, len(used) - 1) or 1
    else:
        wide = (len(used) - 1).bit_length()
        spare = (1 << wide) - len(used)
        for i, s in enumerate(used):
            out[s] = wide - 1 if i < spare else wide
    return out


def canonical(lengths):
    codes, code = {}, 0
    for n in range(1, 16):
        for s, length in enumerate(lengths):
            if length == n:
                codes[s] = (code, n)
                code += 1
        code <<= 1
    return codes


def write_code(w, used, alphabet):
    used = sorted(used) or [0]
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(used[0], 8)
        return {used[0]: (0, 0)}
    if len(used) == 1:
        used = [0, *used]
    lengths = lengths_for(used, alphabet)
    w.put(0, 1)
    w.put(15, 4)  # all 19 lengths of the code-length code
    # runs of zeros as 17 and 18, repeats as 16
    tokens, i, last = [], 0, 8
    while i < alphabet:
        run = 1
        while i + run < alphabet and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 11:
            run = min(run, 138)
            tokens.append((18, run - 11, 7))
        elif lengths[i] == 0 and run >= 3:
            run = min(run, 10)
            tokens.append((17, run - 3, 3))
        elif lengths[i] == last and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run, last = 1, lengths[i] or last
            tokens.append((lengths[i], 0, 0))
        i += run
    of = lengths_for({t for t, _, _ in tokens} | {0, 1}, 19, 8)
    assert max(of) < 8
    for s in webp.LENGTH_ORDER:
        w.put(of[s], 3)
    w.put(0, 1)
    codes = canonical(of)
    for t, extra, n in tokens:
        w.code(t, codes)
        w.put(extra, n)
    return canonical(lengths)


def prefix(value):
    """(symbol, extra, bits) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 1
    second = (value - 1) >> (n - 1) & 1
    return 2 * n + second, (value - 1) & ((1 << (n - 1)) - 1), n - 1


def write_image(w, pixels, width, rng, main=False, cache_bits=0, block=None, copies=True):
    """Pixels (ARGB ints) with literals, copies and cache hits at random."""
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(pixels) // width
    groups = None
    if main:
        w.put(block is not None, 1)
        if block is not None:
            w.put(block - 2, 3)
            across, down = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            groups = [rng.randint(0, 2) for _ in range(across * down)]
            write_image(w, [0xFF000000 | g << 8 for g in groups], across, rng)
    cache, ops, i = {}, [], 0
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)

    while i < len(pixels):
        p, took = pixels[i], 1
        group = groups[((i // width) >> block) * across + ((i % width) >> block)] if groups else 0
        far = rng.choice([1, width, width + 1, 2, rng.randint(1, 300)]) if copies and i else 0
        n = 0
        while 0 < far <= i and i + n < len(pixels) and n < 4000 and pixels[i + n] == pixels[i + n - far]:
            n += 1
        if n >= 2 and rng.random() < 0.9:
            named = [k for k, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == far]
            took = n
            ops.append((group, "copy", n, named[0] + 1 if named and rng.random() < 0.7 else far + 120))
        elif cache_bits and cache.get(key(p)) == p and rng.random() < 0.9:
            ops.append((group, "cache", key(p), 0))
        else:
            ops.append((group, "pixel", p, 0))
        for j in range(i, i + took):
            if cache_bits:
                cache[key(pixels[j])] = pixels[j]
        i += took
    count = max(groups) + 1 if groups else 1
    tables = []
    for g in range(count):
        used = [set() for _ in range(5)]
        for group, kind, x, y in ops:
            if group == g:
                if kind == "pixel":
                    for s, c in zip(used, (x >> 8 & 255, x >> 16 & 255, x & 255, x >> 24), strict=False):
                        s.add(c)
                elif kind == "cache":
                    used[0].add(280 + x)
                else:
                    used[0].add(256 + prefix(x)[0])
                    used[4].add(prefix(y)[0])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        tables.append([write_code(w, u, n) for u, n in zip(used, sizes, strict=True)])
    for group, kind, x, y in ops:
        t = tables[group]
        if kind == "pixel":
            for codes, c in zip(t, (x >> 8 & 255, x >> 16 & 255, x & 255, x >> 24), strict=False):
                w.code(c, codes)
        elif kind == "cache":
            w.code(280 + x, t[0])
        else:
            for codes, base, value in ((t[0], 256, x), (t[4], 0, y)):
                symbol, extra, n = prefix(value)
                w.code(base + symbol, codes)
                w.put(extra, n)


def as_ints(image):
    a = image.astype(np.int64)
    return (a[..., 0] << 24 | a[..., 1] << 16 | a[..., 2] << 8 | a[..., 3]).reshape(-1).tolist()


def predicted(image, modes, bits):
    """Residuals, from the definition of each mode."""
    h, w, _ = image.shape
    out = image.astype(int).copy()
    px = image.astype(int)
    avg = lambda a, b: (a + b) // 2
    for y in range(h):
        for x in range(w):
            if x == 0 and y == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = px[y, x - 1]
            elif x == 0:
                p = px[y - 1, x]
            else:
                left, t, tl = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                tr = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
                m = modes[y >> bits, x >> bits]
                half = lambda a, b: np.clip(a + np.trunc((a - b) / 2).astype(int), 0, 255)
                select = left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
                p = [
                    np.array([255, 0, 0, 0]), left, t, tr, tl, avg(avg(left, tr), t), avg(left, tl), avg(left, t), avg(tl, t), avg(t, tr),
                    avg(avg(left, tl), avg(t, tr)), select, np.clip(left + t - tl, 0, 255), half(avg(left, t), tl),
                ][m]
            out[y, x] = (px[y, x] - p) & 255
    return out.astype(np.uint8)


def signed(x):
    return x - 256 if x > 127 else x


@pytest.mark.parametrize("seed", range(24))
def test_decodes_what_another_encoder_writes(seed):
    rng = random.Random(seed)
    npr = np.random.default_rng(seed)
    w, h = rng.randint(1, 40), rng.randint(1, 30)
    colours = npr.integers(0, 256, (rng.choice([1, 2, 4, 9, 40, 300]), 4)).astype(np.uint8)
    image = colours[npr.integers(0, len(colours), (h, w))]
    if rng.random() < 0.5:
        image = np.repeat(image[:, : max(1, w // 3)], 3, axis=1)[:, :w] if w >= 3 else image
    w = image.shape[1]
    out = Writer()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    now = image
    plan = []
    if len(colours) <= 256 and rng.random() < 0.6:
        plan.append("palette")
    plan += [t for t in ("predictor", "cross", "green") if rng.random() < 0.6]
    if "palette" not in plan:
        rng.shuffle(plan)
    for t in plan:
        out.put(1, 1)
        if t == "palette":
            out.put(webp.PALETTE, 2)
            out.put(len(colours) - 1, 8)
            deltas = np.diff(colours.astype(int), axis=0, prepend=0) & 255
            write_image(out, as_ints(deltas[None]), len(colours), rng)
            index = np.array([[np.flatnonzero((colours == p).all(1))[0] for p in row] for row in image])
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            per, wide = 1 << packed, 8 >> packed
            narrow = np.zeros((h, -(-w // per)), int)
            for x in range(w):
                narrow[:, x // per] |= index[:, x] << (wide * (x % per))
            now = np.zeros((*narrow.shape, 4), np.uint8)
            now[..., 0], now[..., 2] = 255, narrow
        elif t == "green":
            out.put(webp.SUBTRACT_GREEN, 2)
            now = now.copy()
            now[..., 1] -= now[..., 2]
            now[..., 3] -= now[..., 2]
        else:
            bits = rng.randint(2, 4)
            across, down = (now.shape[1] + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
            out.put(webp.PREDICTOR if t == "predictor" else webp.CROSS_COLOUR, 2)
            out.put(bits - 2, 3)
            if t == "predictor":
                modes = npr.integers(0, 14, (down, across))
                write_image(out, [0xFF000000 | int(m) << 8 for m in modes.reshape(-1)], across, rng)
                now = predicted(now, modes, bits)
            else:
                f = npr.integers(0, 256, (down, across, 3))
                write_image(out, [0xFF000000 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b in f.reshape(-1, 3)], across, rng)
                changed = now.copy()
                for y in range(h):
                    for x in range(now.shape[1]):
                        _, r, g, b = (int(v) for v in now[y, x])
                        red_blue, green_blue, green_red = (signed(int(v)) for v in f[y >> bits, x >> bits])
                        changed[y, x, 1] = (r - (green_red * signed(g) >> 5)) & 255
                        changed[y, x, 3] = (b - (green_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5)) & 255
                now = changed
    out.put(0, 1)
    write_image(out, as_ints(now), now.shape[1], rng, main=True, cache_bits=rng.choice([0, 1, 5, 11]), block=rng.choice([None, 2, 3]))
    got = decode(out.file())
    assert got.shape == (h, w, 4)
    assert (got == image[..., [1, 2, 3, 0]]).all()


def test_round_trip_of_payloads():
    rng = np.random.default_rng(2)
    for n in (64, 128, 64 * 99, 64 * webp.MAX_SIDE, 64 * (2 * webp.MAX_SIDE + 1)):
        for k in (1, 2, 3, 33, 256):
            payload = rng.integers(0, k, n).astype(np.uint8)
            media = encode(payload)
            assert (decode(media).reshape(-1)[:n] == payload).all()
            assert media == encode(payload.copy())


def chosen(media):
    bits = webp.Bits(media[21:])
    bits.read(32)
    return bits.read(2) if bits.read(1) else None


def test_each_transform_is_chosen_where_it_pays():
    rng = np.random.default_rng(5)
    noise = lambda n=4: rng.integers(0, n, (64, 16)).astype(np.uint8)
    pixels = np.zeros((64, 16, 4), np.uint8)
    pixels[..., 3] = 255
    cases = {}
    slope = pixels.copy()
    slope[..., :3] = np.cumsum(rng.integers(0, 3, (64, 16, 3)), axis=0)
    cases[webp.PREDICTOR] = slope
    grey = pixels.copy()
    grey[..., 1] = rng.integers(0, 256, (64, 16))
    grey[..., 0] = grey[..., 1] + noise()
    grey[..., 2] = grey[..., 1] + noise()
    cases[webp.SUBTRACT_GREEN] = grey
    tied = grey.copy()
    green = tied[..., 1].view(np.int8).astype(int)
    tied[..., 0] = (noise() + (green * 20 >> 5)).astype(np.uint8)
    tied[..., 2] = (noise() - (green * 11 >> 5)).astype(np.uint8)
    cases[webp.CROSS_COLOUR] = tied
    cases[webp.PALETTE] = rng.integers(0, 256, (200, 4)).astype(np.uint8)[rng.integers(0, 200, (64, 16))]
    for kind, image in cases.items():
        media = encode(image.reshape(-1))
        assert chosen(media) == kind
        assert (decode(media) == image).all()
        assert len(media) < len(webp._file(np.ascontiguousarray(image[..., [3, 0, 1, 2]])))


def test_copies_and_cache_shorten_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=3)) + " " for _ in range(40)]
    text = np.frombuffer("".join(rng.choices(words, k=3200)).encode(), np.uint8)
    media = encode(text)
    assert (decode(media).reshape(-1)[: len(text)] == text).all()
    assert len(media) < len(text) * 0.3
    again = encode(np.concatenate((text, text)))
    assert len(again) < len(media) + 200


def test_colours_asked_before_they_are_there_are_black():
    out = Writer()
    out.put(15, 14)
    out.put(3, 14)
    out.put(0, 5)
    out.put(1, 1)
    out.put(3, 4)
    out.put(0, 1)
    write = [write_code(out, used, n) for used, n in (({7, 285}, 288), ({0}, 256), ({0}, 256), ({255}, 256), (set(), 40))]
    symbols = [285, 7] * 32
    for s in symbols:
        out.code(s, write[0])
    got = decode(out.file()).reshape(-1, 4).tolist()
    # place 5 is asked for; it is filled only if a literal or black falls there
    place = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 29
    cache, want = [0] * 8, []
    for s in symbols:
        p = cache[5] if s == 285 else 0xFF000700
        cache[place(p)] = p
        want.append([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24])
    assert got == want


def test_broken_media_are_refused():
    media = encode(np.arange(64, dtype=np.uint8))
    for bad in (b"", b"RIFF", media[:30], b"X" + media[1:], media[:20] + b"\x00" + media[21:]):
        with pytest.raises(Corrupt):
            decode(bad)


def test_many_at_once_equal_each_alone(monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(1, 9))) for _ in range(60)]
    texts = ["", "x" * 64, "ab" * 3000, *(" ".join(rng.choices(words, k=int(rng.paretovariate(0.7) * 20) % 3000)) for _ in range(150))]
    payloads = [np.frombuffer(t.encode().ljust(max(1, -(-len(t.encode()) // 64)) * 64, b"\0"), np.uint8) for t in texts]
    payloads.append(np.random.default_rng(1).integers(0, 9, 64 * (webp.MAX_SIDE + 1)).astype(np.uint8))
    media = [encode(p) for p in payloads]
    searched = []
    copies = webp._write_images
    monkeypatch.setattr(webp, "_write_images", lambda outs, *more, **named: searched.append(len(outs)) or copies(outs, *more, **named))
    assert webp.encode_all(payloads) == media
    assert max(searched) > 20  # their symbols are counted and coded together
    broken = [b"", media[40][:-40], media[41][: len(media[41]) // 2], media[42][:60] + bytes(200)]
    alone = []
    for blob in broken:
        with pytest.raises(Corrupt):
            decode(blob)
    monkeypatch.setattr(webp, "decode", lambda blob: alone.append(blob) or decode(blob))
    for fewest in (1, 48):
        monkeypatch.setattr(webp, "FEWEST_LANES", fewest)
        got = webp.decode_all([*broken, *media])
        assert [x is None for x in got] == [True] * len(broken) + [False] * len(media)
        assert all((image.reshape(-1)[: len(p)] == p).all() for image, p in zip(got[len(broken) :], payloads, strict=True))
    assert set(alone) <= set(broken)


def test_columns(spark, docs_of):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 70_000, "same", "same"]
    docs = docs_of(texts).withColumns({"media": F.lit("mine"), "n_bytes": F.lit("mine")})
    media = encode_media(docs, ["doc_id", "n_bytes", "lang"])
    rows = decode_media(media, ["doc_id", "n_bytes", "payload_bytes", "media", "lang"]).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert bytes(r.pixels)[: len(padded)] == padded
        assert r.width * r.height * 4 == len(r.pixels)
        assert r.feature == average_hash(np.frombuffer(bytes(r.pixels), np.uint8))
    assert rows[6].media == rows[7].media and rows[6].feature == rows[7].feature
    assert encode_media(docs_of([]), ["doc_id"]).collect() == []
    broken = spark.createDataFrame([(1, b"nope"), (2, None)], "doc_id long, media binary")
    assert [r.pixels for r in decode_media(broken, ["doc_id"]).collect()] == [None, None]


def test_query_gives_the_contract(docs_of, tmp_path):
    from tidewire.llm.queries import op10_webp

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(1, 9))) for _ in range(30)]
    texts = [None, "", "x" * 63, "x" * 64, "x" * 65, "\x00", "é" * 500, *(" ".join(rng.choices(words, k=rng.randint(1, 3000))) for _ in range(12))]
    texts += texts[-3:]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark = docs_of([]).sparkSession
    rows = {r.doc_id: r for r in op10_webp(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        media = encode(np.frombuffer(payload, np.uint8))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.feature == average_hash(decode(media).reshape(-1))
