"""Media columns: lossless WebP (VP8L) decoded to pixel arrays, and a writer for byte payloads.

The decoder reads simple files and animations, all of whose frames are lossless. The images of a batch are decoded in
step: each step takes one pixel of every image, with table look-ups for the prefix codes, copies for back-references
and slots of the colour caches as arrays over the images. Transforms are undone image by image. The format is that of
the public WebP Lossless Bitstream Specification.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN, COLOUR, DISTANCE = 256 + 24, 256, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Distance codes 1..120 name near pixels (x left, y up), by distance, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Reads a byte string from the least bit on; beyond its end are zeros."""

    def __init__(self, data: bytes) -> None:
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        if self.at > self.end:
            raise ValueError("the image data end too early")
        return self.value >> at & (1 << n) - 1


@lru_cache(maxsize=64)
def _table(lengths: bytes) -> tuple[np.ndarray, int]:
    """Look-up table of a canonical prefix code: symbol * 16 + length by the next bits; and the mask of those bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if not used:
        raise ValueError("a prefix code has no symbol")
    if len(used) == 1:
        return np.array([used[0] << 4], np.int32), 0
    longest = max(lengths)
    if sum(1 << longest - lengths[s] for s in used) != 1 << longest:
        raise ValueError("a prefix code is not complete")
    table = np.zeros(1 << longest, np.int32)
    code = 0
    for n in range(1, longest + 1):
        code <<= 1
        for s in used:
            if lengths[s] == n:
                table[int(f"{code:0{n}b}"[::-1], 2) :: 1 << n] = s << 4 | n
                code += 1
    return table, (1 << longest) - 1


def _symbol(bits: Bits, table: np.ndarray, mask: int) -> int:
    entry = int(table[bits.value >> bits.at & mask])
    bits.read(entry & 15)
    return entry >> 4


def _read_code(bits: Bits, alphabet: int) -> bytes:
    lengths = bytearray(alphabet)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol is outside its alphabet")
            lengths[s] = 1
        return bytes(lengths)
    code = bytearray(19)
    for k in range(4 + bits.read(4)):
        code[CODE_LENGTH_ORDER[k]] = bits.read(3)
    table, mask = _table(bytes(code))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        s = _symbol(bits, table, mask)
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        value, n = (previous, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = bytes([value]) * n
        at += n
    return bytes(lengths)


class Job:
    """An entropy-coded image whose prefix codes are read: where its pixels begin and how they are coded."""

    def __init__(self, bits: Bits, data: bytes, width: int, height: int, top: bool) -> None:
        self.data, self.width, self.height = data, width, height
        self.cache = bits.read(4) if bits.read(1) else 0
        self.blocks, self.size_bits, groups = None, 0, 1
        if top and bits.read(1):
            self.size_bits = 2 + bits.read(3)
            across = -(-width >> self.size_bits)
            image = small_image(bits, data, across, -(-height >> self.size_bits))
            self.blocks = (image >> 8 & 0xFFFF).astype(np.int64)
            groups = int(self.blocks.max()) + 1
        self.codes = self._codes(bits, groups)
        self.at = bits.at

    def _codes(self, bits: Bits, groups: int) -> list[tuple[bytes, ...]]:
        alphabets = (GREEN + (1 << self.cache if self.cache else 0), COLOUR, COLOUR, COLOUR, DISTANCE)
        # Many images begin with the same codes; what has been read once is known by its bits.
        for (n, wanted, sizes), found in _KNOWN.items():
            if groups == 1 and sizes == alphabets and bits.at + n <= bits.end and bits.value >> bits.at & (1 << n) - 1 == wanted:
                bits.at += n
                return [found]
        start = bits.at
        codes = [tuple(_read_code(bits, a) for a in alphabets) for _ in range(groups)]
        if groups == 1:
            if len(_KNOWN) >= 8:
                _KNOWN.clear()
            n = bits.at - start
            _KNOWN[n, bits.value >> start & (1 << n) - 1, alphabets] = codes[0]
        return codes


_KNOWN: dict = {}


def small_image(bits: Bits, data: bytes, width: int, height: int) -> np.ndarray:
    """An image inside an image (palette, block modes, code groups): its pixels; the reader moves on."""
    job = Job(bits, data, width, height, False)
    pixels, ends = entropy_decode([job])
    bits.at = ends[0]
    return pixels[0]


def entropy_decode(jobs: list[Job]) -> tuple[list[np.ndarray], list[int]]:
    """ARGB pixels of every job and the bit at which each ends; all jobs go in step, a pixel of each at a time."""
    tables: dict[bytes, tuple[int, int]] = {}
    parts, size = [], 0
    for job in jobs:
        for group in job.codes:
            for code in group:
                if code not in tables:
                    table, mask = _table(code)
                    tables[code] = size, mask
                    parts.append(table)
                    size += len(table)
    table = np.concatenate(parts)
    groups = np.array([[tables[c] for c in g] for job in jobs for g in job.codes], np.int64)  # group, code, (offset, mask)
    first_group = np.cumsum([0] + [len(j.codes) for j in jobs])[:-1]

    starts = np.cumsum([0] + [len(j.data) + 8 for j in jobs])
    raw = np.zeros(int(starts[-1]) + 8, np.uint8)
    for job, at in zip(jobs, starts, strict=False):
        raw[at : at + len(job.data)] = np.frombuffer(job.data, np.uint8)
    words = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,))  # the 64 bits from any byte on

    counts = np.array([j.width * j.height for j in jobs], np.int64)
    base = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(base[-1]), np.uint32)
    slots = np.array([1 << j.cache if j.cache else 0 for j in jobs], np.int64)
    cache_base = np.concatenate(([0], np.cumsum(slots)))
    caches = np.zeros(int(cache_base[-1]) + 1, np.uint32)
    near = np.array(NEAR, np.int64)
    any_cache, blocks = bool(slots.any()), [j.blocks for j in jobs]
    any_blocks = any(b is not None for b in blocks)

    job = np.flatnonzero(counts)
    bit = starts[job] * 8 + np.array([j.at for j in jobs], np.int64)[job]
    at, end, width = base[job].copy(), base[job] + counts[job], np.array([j.width for j in jobs], np.int64)[job]
    left, back = np.zeros(len(job), np.int64), np.zeros(len(job), np.int64)
    shift = np.array([32 - j.cache for j in jobs], np.uint32)[job]
    cached, slot0, limit = slots[job] > 0, cache_base[job], (starts[job] + np.array([len(j.data) for j in jobs])[job]) * 8
    code = groups[first_group[job]]
    finished = np.zeros(len(jobs), np.int64)

    def peek(position: np.ndarray) -> np.ndarray:
        return words[position >> 3] >> (position & 7).astype(np.uint64)

    def look(position: np.ndarray, of: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        entry = table[of[:, kind, 0] + (peek(position).astype(np.int64) & of[:, kind, 1])]
        return entry >> 4, position + (entry & 15)

    def extra(prefix: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value that a length or distance prefix and its further bits stand for."""
        n = np.maximum(prefix - 2, 0) >> 1
        low = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n)
        return low + (peek(position).astype(np.int64) & (1 << n) - 1) + 1, position + n

    while len(job):
        if any_blocks:
            place = at - base[job]
            for k, j in enumerate(job.tolist()):
                if blocks[j] is not None and not left[k]:
                    y, x = divmod(int(place[k]), jobs[j].width)
                    code[k] = groups[first_group[j] + blocks[j][(y >> jobs[j].size_bits) * -(-jobs[j].width >> jobs[j].size_bits) + (x >> jobs[j].size_bits)]]
        reads = left == 0
        everyone = bool(reads.all())
        r = slice(None) if everyone else np.flatnonzero(reads)
        c = code[r]
        position = bit[r]
        entry = table[c[:, 0, 0] + (peek(position).astype(np.int64) & c[:, 0, 1])]
        symbol, position = entry >> 4, position + (entry & 15)
        literal = symbol < 256
        pure = bool(literal.all())
        k = slice(None) if pure else np.flatnonzero(literal)
        red, p = look(position[k], c[k], 1)
        blue, p = look(p, c[k], 2)
        alpha, p = look(p, c[k], 3)
        colour = (alpha.astype(np.uint32) << 24) | (red.astype(np.uint32) << 16) | (symbol[k].astype(np.uint32) << 8) | blue.astype(np.uint32)
        if pure:
            pixel, position = colour, p
        else:
            pixel = np.zeros(len(symbol), np.uint32)
            pixel[k], position[k] = colour, p
            copies = np.flatnonzero((symbol >= 256) & (symbol < GREEN))
            hits = np.flatnonzero(symbol >= GREEN)
            own = np.arange(len(job))[r]
            if len(hits):
                pixel[hits] = caches[slot0[own[hits]] + symbol[hits] - GREEN]
            if len(copies):
                length, p = extra(symbol[copies] - 256, position[copies])
                prefix, p = look(p, c[copies], 4)
                distance, p = extra(prefix, p)
                who = own[copies]
                named = near[np.minimum(distance, 120) - 1]
                distance = np.where(distance > 120, distance - 120, np.maximum(1, named[:, 0] + named[:, 1] * width[who]))
                if (distance > at[who] - base[job[who]]).any() or (length > end[who] - at[who]).any():
                    raise ValueError("a back-reference leaves the image")
                left[who], back[who], position[copies] = length, distance, p
        bit[r] = position
        if everyone and pure:
            out[at] = pixel
        else:
            if not everyone:
                full = np.zeros(len(job), np.uint32)
                full[r] = pixel
                pixel = full
            copying = np.flatnonzero(left)
            pixel[copying] = out[at[copying] - back[copying]]
            left[copying] -= 1
            out[at] = pixel
        if any_cache:
            some = slice(None) if cached.all() else np.flatnonzero(cached)
            caches[slot0[some] + ((pixel[some] * np.uint32(CACHE_FACTOR)) >> shift[some]).astype(np.int64)] = pixel[some]
        at += 1
        over = at == end
        if over.any():
            if (bit > limit).any():
                raise ValueError("the image data end too early")
            finished[job[over]] = bit[over] - starts[job[over]] * 8
            stay = np.flatnonzero(~over)
            job, bit, at, end, width, left, back, shift, cached, slot0, limit, code = (x[stay] for x in (job, bit, at, end, width, left, back, shift, cached, slot0, limit, code))
    return [out[base[k] : base[k + 1]] for k in range(len(jobs))], finished.tolist()


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(…, 4) of alpha, red, green, blue as int32."""
    return np.stack([(pixels >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)], -1)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = (channels & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, l: np.ndarray, t: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:  # noqa: E741
    average = lambda a, b: (a + b) >> 1
    if mode == 11:
        nearer_left = np.abs(t - tl).sum() < np.abs(l - tl).sum()
        return l if nearer_left else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        a = average(l, t)
        d = a - tl
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    black = np.array([255, 0, 0, 0], np.int32)
    return (black, l, t, tr, tl, average(average(l, tr), t), average(l, tl), average(l, t), average(tl, t), average(t, tr), average(average(l, tl), average(t, tr)))[mode if mode < 11 else 0]


def undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Each pixel is its residual plus what its mode predicts from the pixels left and above."""
    c = _channels(pixels).reshape(height, width, 4)
    across = -(-width >> size_bits)
    if width and height:
        c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
        c[0] = np.cumsum(c[0], axis=0) & 255
    if height and (modes >> 8 & 15 == 2).all():  # every pixel by the one above it
        return _joined(np.cumsum(c, axis=0)).reshape(-1)
    for y in range(1, height):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        following = np.concatenate((above[1:], row[:1]))  # above right; at the end the row's own first pixel
        for x in range(1, width):
            mode = int(modes[(y >> size_bits) * across + (x >> size_bits)]) >> 8 & 15
            row[x] = (row[x] + _predicted(mode, row[x - 1], above[x], above[x - 1], following[x])) & 255
    return _joined(c).reshape(-1)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, size_bits: int) -> np.ndarray:
    """Red and blue regain what green (and red) foretold of them, by the factors of their block."""
    c = _channels(pixels).reshape(height, width, 4)
    y, x = np.mgrid[0:height, 0:width]
    f = _channels(factors)[(y >> size_bits) * -(-width >> size_bits) + (x >> size_bits)]
    signed = lambda v: (v & 255 ^ 128) - 128
    part = lambda factor, value: signed(factor) * signed(value) >> 5
    c[..., 1] = (c[..., 1] + part(f[..., 3], c[..., 2])) & 255
    c[..., 3] = (c[..., 3] + part(f[..., 2], c[..., 2]) + part(f[..., 1], c[..., 1])) & 255
    return _joined(c).reshape(-1)


def undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray, pack: int) -> np.ndarray:
    """Green holds indices, 1 << pack of them; those beyond the palette are transparent black."""
    packed = (pixels >> 8 & 0xFF).reshape(height, -1)
    depth, x = 8 >> pack, np.arange(width)
    index = packed[:, x >> pack] >> ((x & (1 << pack) - 1) * depth).astype(np.uint32) & (1 << depth) - 1
    colours = np.zeros(256, np.uint32)
    colours[: len(palette)] = palette
    return colours[index].reshape(-1)


class Image:
    """A VP8L chunk: header and transforms are read at once, the pixels by decode()."""

    def __init__(self, data: bytes) -> None:
        if data[:1] != b"\x2f":
            raise ValueError("no lossless WebP image")
        bits = Bits(data)
        bits.at = 8
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.steps: list[tuple] = []
        width = self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in [s[0] for s in self.steps]:
                raise ValueError("a transform occurs twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                size_bits = 2 + bits.read(3)
                self.steps.append((kind, width, small_image(bits, data, -(-width >> size_bits), -(-self.height >> size_bits)), size_bits))
            elif kind == PALETTE:
                n = 1 + bits.read(8)
                palette = _joined(np.cumsum(_channels(small_image(bits, data, n, 1)), axis=0))
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.steps.append((kind, width, palette, pack))
                width = -(-width >> pack)
            else:
                self.steps.append((kind, width, None, 0))
        self.job = Job(bits, data, width, self.height, True)

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        for kind, width, values, n in reversed(self.steps):
            if kind == PREDICTOR:
                pixels = undo_predictor(pixels, width, self.height, values, n)
            elif kind == CROSS_COLOUR:
                pixels = undo_cross_colour(pixels, width, self.height, values, n)
            elif kind == PALETTE:
                pixels = undo_palette(pixels, width, self.height, values, n)
            else:
                c = _channels(pixels)
                c[:, 1] += c[:, 2]
                c[:, 3] += c[:, 2]
                pixels = _joined(c)
        return pixels


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The VP8L chunks of a WebP file with their frames' headers (empty for a simple file)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")

    def walk(part: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(part):
            name, n = part[at : at + 4], struct.unpack_from("<I", part, at + 4)[0]
            yield name, part[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)

    for name, body in walk(data[12 : 8 + struct.unpack_from("<I", data, 4)[0]]):
        if name == b"VP8L":
            yield b"", body
        elif name == b"ANMF":
            for inner, image in walk(body[16:]):
                if inner == b"VP8L":
                    yield body[:16], image
                elif inner == b"VP8 ":
                    raise ValueError("a frame is lossy")
        elif name == b"VP8 ":
            raise ValueError("the image is lossy")


def decode(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, ARGB pixels) of each frame of each file; all images are decoded together."""
    images = [[Image(body) for _, body in chunks(f)] for f in files]
    flat = [i for some in images for i in some]
    pixels = iter(entropy_decode([i.job for i in flat])[0] if flat else [])
    return [[(i.width, i.height, i.finish(next(pixels))) for i in some] for some in images]


# The writer: a payload of bytes as rows of WIDTH RGB pixels, in frames of at most ROWS rows.

#: Pixels of a row (192 bytes), rows of a frame, bits of the colour cache, and the shortest run that is copied.
WIDTH, ROWS, CACHE_BITS, LEAST_RUN = 64, 64, 8, 4
#: Bytes that texts have most, most frequent first; they get the short codes.
FREQUENT = b" etaoinsrhldcumfpgwybv,.k\nETAOINSRHLDCUMFPGWYBVKxjqz0123456789-'\"\xc3\xa9\xa8\xbc\xb3!()%*#&$|:;/"


def code_lengths(weights: list[float]) -> bytes:
    """Lengths of a Huffman code; the weights must not be so far apart that a length exceeds 15."""
    heap = [(w, k, (k,)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = bytearray(len(weights))
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            lengths[k] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return bytes(lengths)


def _bit_codes(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code as it stands in the stream (first bit lowest), and its length."""
    codes, code = np.zeros(len(lengths), np.uint64), 0
    for n in range(1, max(lengths) + 1):
        code <<= 1
        for s, own in enumerate(lengths):
            if own == n:
                codes[s] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
    return codes, np.frombuffer(lengths, np.uint8).astype(np.int64)


class BitWriter:
    """Bits, the first the lowest."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def single(self, symbol: int) -> None:
        """A prefix code of one symbol, which takes no bits."""
        for value, bits in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.put(value, bits)

    def lengths(self, code: bytes) -> None:
        """A prefix code by the lengths of its symbols, 4 bits each."""
        self.put(0, 1)
        self.put(15, 4)  # all 19 lengths of the code-length code: 4 bits each for 0..15, none for the repeats
        for s in CODE_LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for own in code:
            self.put(int(f"{own:04b}"[::-1], 2), 4)


#: Of an image's pixels, the part that must be like the one above for the predictor; the most colours of a palette.
ABOVE, PALETTE_COLOURS = 0.5, 16


@lru_cache(maxsize=2)
def writer_codes(predicted: bool = False) -> tuple:
    """The writer's prefix codes, the same for all payloads, and the bits that announce them after the image's size.
    predicted: with a predictor transform before them, every pixel by the one above it."""
    byte = [1.0] * 256
    for rank, b in enumerate(FREQUENT):
        byte[b] = 600 / (rank + 4)
    green = code_lengths(byte + [2.0] * 24 + [6.0] * (1 << CACHE_BITS))
    colour = code_lengths(byte)
    w = BitWriter()
    if predicted:
        for value, bits in ((1, 1), (PREDICTOR, 2), (7, 3), (0, 1)):  # blocks of 512 pixels: one mode for the image
            w.put(value, bits)
        for symbol in (2, 0, 0, 255, 0):
            w.single(symbol)
    w.put(0, 1)  # no further transform
    w.put(1, 1)
    w.put(CACHE_BITS, 4)
    w.put(0, 1)  # one group of codes
    for code in (green, colour, colour):
        w.lengths(code)
    w.single(0 if predicted else 255)  # alpha
    w.single(1)  # distance code 2, the pixel to the left
    return _bit_codes(green), _bit_codes(colour), w.value, w.n


def palette_image(pixel: np.ndarray, rows: int) -> bytes:
    """An image of at most PALETTE_COLOURS colours: palette, then several indices to a pixel, eight bits or none each."""
    colours, index = np.unique(pixel, return_inverse=True)
    n = len(colours)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1
    depth, w = 8 >> pack, BitWriter()
    for value, bits in ((0x2F, 8), (WIDTH - 1, 14), (rows - 1, 14), (0, 4), (1, 1), (PALETTE, 2), (n - 1, 8), (0, 1)):
        w.put(int(value), bits)
    parts = _channels(colours.astype(np.uint32))
    steps = np.diff(parts, axis=0, prepend=0) & 255  # each colour less the one before
    flat = bytes([8] * 256)
    for code in (flat + bytes(24), flat, flat):
        w.lengths(code)
    if n == 1:
        w.single(255)
    else:  # the first alpha is 255, the steps are 0
        for value, bits in ((1, 1), (1, 1), (1, 1), (0, 8), (255, 8)):
            w.put(value, bits)
    w.single(0)
    reverse = lambda v: int(f"{int(v):08b}"[::-1], 2)
    for a, red, green, blue in steps.tolist():
        for v in (green, red, blue):
            w.put(reverse(v), 8)
        if n > 1:
            w.put(a & 1, 1)
    for _ in range(3):
        w.put(0, 1)  # no further transform, no cache, one group
    packed = (index.reshape(-1, 1 << pack) << depth * np.arange(1 << pack)).sum(1)
    even = bool((packed == packed[0]).all())
    if even:
        w.single(int(packed[0]))
    else:
        w.lengths(flat + bytes(24))
    for symbol in (0, 0, 0, 0):
        w.single(symbol)
    body = w.value.to_bytes(-(-w.n // 8), "little")
    if even:
        return body
    tail = int.from_bytes(bytes(map(reverse, packed.tolist())), "little")
    return (w.value | tail << w.n).to_bytes(-(-(w.n + 8 * len(packed)) // 8), "little")


def encode(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload (a positive multiple of 3 * WIDTH bytes); equal payloads give equal files.

    An image most of whose pixels are like the ones above is predicted by these; one of few colours gets a palette if
    that makes it smaller."""
    (green, green_n), (colour, colour_n), *_ = writer_codes()
    size = 3 * WIDTH * ROWS
    tiles = [p[a : a + size] for p in payloads for a in range(0, len(p), size)]
    rgb = np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 3).astype(np.int64)
    rows = np.array([len(t) // (3 * WIDTH) for t in tiles], np.int64)
    ends = np.cumsum(rows * WIDTH)
    starts = ends - rows * WIDTH
    tile = np.repeat(np.arange(len(tiles)), rows * WIDTH)
    pixel = (255 << 24 | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]).astype(np.uint32)
    original = pixel
    alike = np.zeros(len(pixel), bool)
    alike[WIDTH:] = pixel[WIDTH:] == pixel[:-WIDTH]
    alike[(starts[:, None] + np.arange(WIDTH)).ravel()] = False
    predicted = np.add.reduceat(alike, starts, dtype=np.int64) > ABOVE * rows * WIDTH
    if predicted.any():
        rest = rgb.copy()
        rest[WIDTH:] -= rgb[:-WIDTH]
        first = np.zeros(len(rgb), bool)
        first[(starts[:, None] + np.arange(WIDTH)).ravel()] = True
        rest[1:][first[1:]] = (rgb[1:] - rgb[:-1])[first[1:]]
        rest[starts] = rgb[starts]
        use = np.repeat(predicted, rows * WIDTH)
        rgb = np.where(use[:, None], rest & 255, rgb)
        pixel = (np.where(use, 0, 255 << 24) | rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]).astype(np.uint32)
    red, grn, blue = rgb[:, 0], rgb[:, 1], rgb[:, 2]
    heads = [(0x2F | WIDTH - 1 << 8 | head << 40, n + 40) for *_, head, n in (writer_codes(), writer_codes(True))]
    head_n = np.array([n for _, n in heads], np.int64)[predicted.astype(int)]

    # Runs of a pixel like the one to its left become one copy.
    same = np.concatenate(([False], pixel[1:] == pixel[:-1]))
    same[starts] = False
    edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - begin >= LEAST_RUN
    begin, run = begin[long], (stop - begin)[long]
    covered = np.zeros(len(pixel) + 1, np.int64)
    np.add.at(covered, begin, 1)
    np.add.at(covered, begin + run, -1)
    covered = np.cumsum(covered[:-1]) > 0
    # A pixel is in the cache if the last one of its slot, in its image, was the same.
    slot = ((pixel * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    order = np.argsort(tile << CACHE_BITS | slot, kind="stable")
    key = (tile << CACHE_BITS | slot)[order]
    hit = np.zeros(len(pixel), bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (pixel[order[1:]] == pixel[order[:-1]])

    value = green[grn] | colour[red] << green_n[grn].astype(np.uint64) | colour[blue] << (green_n[grn] + colour_n[red]).astype(np.uint64)
    bits = green_n[grn] + colour_n[red] + colour_n[blue]
    value[hit], bits[hit] = green[GREEN + slot[hit]], green_n[GREEN + slot[hit]]
    value[covered], bits[covered] = 0, 0
    if len(begin):
        top = np.floor(np.log2(np.maximum(run - 1, 1))).astype(np.int64)
        prefix = np.where(run <= 4, run - 1, 2 * top + ((run - 1) >> np.maximum(top - 1, 0) & 1))
        n = np.maximum(prefix - 2, 0) >> 1
        rest = np.where(run <= 4, 0, run - 1 - ((2 + (prefix & 1)) << n))
        value[begin] = green[256 + prefix] | rest.astype(np.uint64) << green_n[256 + prefix].astype(np.uint64)
        bits[begin] = green_n[256 + prefix] + n

    # Every image begins at a whole word of one long stream.
    total = np.add.reduceat(bits, starts) + head_n
    words = (total + 63) >> 6
    word0 = np.concatenate(([0], np.cumsum(words)))
    up_to = np.cumsum(bits)
    offset = up_to - bits
    offset += np.repeat(word0[:-1] * 64 + head_n - offset[starts], rows * WIDTH)
    stream = np.zeros(int(word0[-1]) + 1, np.uint64)
    index, shift = offset >> 6, (offset & 63).astype(np.uint64)
    group = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    stream[index[group]] |= np.bitwise_or.reduceat(value << shift, group)
    spill = np.flatnonzero((offset & 63) + bits > 64)
    stream[index[spill] + 1] |= value[spill] >> (np.uint64(64) - shift[spill])
    for (head, n), own in zip(heads, (~predicted, predicted), strict=True):
        for k, w in enumerate(np.frombuffer(head.to_bytes(-(-n // 64) * 8, "little"), "<u8")):
            stream[word0[:-1][own] + k] |= w
    stream[word0[:-1]] |= (rows - 1).astype(np.uint64) << np.uint64(22)
    raw = stream.tobytes()

    # Few colours: in each image sorted, counted where they change.
    order = np.lexsort((original, tile))
    new = np.concatenate(([True], (original[order][1:] != original[order][:-1]) | (tile[order][1:] != tile[order][:-1])))
    few = np.bincount(tile[order][new], minlength=len(tiles)) <= PALETTE_COLOURS
    out, k = [], 0
    for p in payloads:
        images = []
        for _ in range(0, len(p), size):
            image = raw[int(word0[k]) * 8 : int(word0[k]) * 8 + int(total[k] + 7 >> 3)]
            if few[k]:
                image = min(image, palette_image(original[starts[k] : ends[k]], int(rows[k])), key=len)
            images.append(image)
            k += 1
        out.append(_file(images, len(p) // (3 * WIDTH)))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _file(images: list[bytes], height: int) -> bytes:
    """A simple file for one image; else an animation whose frames stand below each other."""
    if len(images) == 1:
        body = _chunk(b"VP8L", images[0])
    else:
        three = lambda n: struct.pack("<I", n)[:3]
        body = _chunk(b"VP8X", b"\x02\0\0\0" + three(WIDTH - 1) + three(height - 1)) + _chunk(b"ANIM", bytes(6))
        for k, image in enumerate(images):
            rows = min(ROWS, height - k * ROWS)
            body += _chunk(b"ANMF", three(0) + three(k * ROWS // 2) + three(WIDTH - 1) + three(rows - 1) + bytes(4) + _chunk(b"VP8L", image))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
