"""Baseline JPEG in numpy: grey images of flat 8 x 8 blocks out, DC-only luminance thumbnails in.

Restart intervals do not depend on each other, so the decoder walks through all intervals of many
images in step, one symbol of each at a time.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

BLOCKS_WIDE = 24
MOST_ROWS = 8184  # of blocks in an image; 65,535 lines are the format's limit
#: A DC code of 15 - c bits for category c, its c bits and one bit for the end of the block make two whole bytes a
#: block. So equal runs of samples are equal runs of bytes, which the table's compression finds, and as no code begins
#: with eight ones no byte is 255.
DC_LENGTHS = (*[0] * 6, *[1] * 9, 0)
DC_VALUES = tuple(range(8, -1, -1))
#: The only AC symbol that flat blocks need: end of block, in one bit.
AC_LENGTHS = (1, *[0] * 15)
AC_VALUES = (0,)


def codes(lengths: tuple[int, ...], values: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(code, length, value), canonical."""
    out, code, k = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            out.append((code, length, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(lengths: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits ahead: length << 8 | value of the code they begin with, 0 where there is none."""
    table = np.zeros(1 << 16, np.int32)
    for code, length, value in codes(lengths, values):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | value
    return table


def _block_bytes() -> np.ndarray:
    """The two bytes of a flat block, by the difference of its DC value from the last one's, plus 255."""
    by_category = {value: (code, length) for code, length, value in codes(DC_LENGTHS, DC_VALUES)}
    out = np.zeros(511, ">u2")
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = by_category[category]
        if length + category != 15:
            raise ValueError("a block has to fill two bytes")
        out[d + 255] = (code << category | (d if d >= 0 else d + (1 << category) - 1)) << 1
    return out


_BYTES = _block_bytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    table = bytes([8, *[1] * 63])
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + table),
        _segment(0xC0, struct.pack(">BHHB3B", 8, rows * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_VALUES])), _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_VALUES])),
        _segment(0xDD, struct.pack(">H", BLOCKS_WIDE)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def encode(samples: np.ndarray) -> bytes:
    """The image of one flat block a sample (uint8); BLOCKS_WIDE samples make a row of blocks and a restart interval."""
    values = samples.reshape(-1, BLOCKS_WIDE).astype(np.int16)
    rows = len(values)
    steps = values + 127  # of the first of a row: from 128, plus 255
    steps[:, 1:] += 128 - values[:, :-1]
    out = np.empty((rows, 2 * BLOCKS_WIDE + 2), np.uint8)
    out[:, :-2] = _BYTES[steps].view(np.uint8)
    out[:, -2] = 255
    out[:, -1] = 0xD0 + np.arange(rows) % 8
    out[-1, -1] = 0xD9
    return _header(rows) + out.tobytes()


@dataclass
class Image:
    """What the markers say, and where the scan's bytes are."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # of components: id, h, v, table
    quantum: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple] = field(default_factory=dict)
    use: list[tuple[int, int]] = field(default_factory=list)  # of the scan's components: DC and AC table
    restart: int = 0
    begin: int = 0
    end: int = 0


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of the image that begins at ``at``, up to its end marker."""
    image = Image()
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while data[at + 1] == 255:
            at += 1
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                image.quantum[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 65 + 64 * wide
        elif marker == 0xC0:
            precision, image.height, image.width, parts = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("not 8 bits a sample")
            image.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * parts, 3)]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = tuple(body[k + 1 : k + 17])
                image.tables[body[k]] = lengths, tuple(body[k + 17 : k + 17 + sum(lengths)])
                k += 17 + sum(lengths)
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            image.use = [(body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(image.use) != len(image.parts):
                raise ValueError("a scan must hold all components")
            break
    image.begin = at
    while True:  # to the first marker that is neither a stuffed 255 nor a restart
        at = data.index(b"\xff", at)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            break
        at += 2
    image.end = at
    return image


#: Scan bytes, about, that are decoded in step; each takes some 20 bytes of memory.
STEP_BYTES = 1 << 20
_tables: dict[tuple, np.ndarray] = {}


def _table(spec: tuple) -> np.ndarray:
    if spec not in _tables:
        _tables[spec] = lookup(*spec)
    return _tables[spec]


def luminance(data: np.ndarray, images: list[Image]) -> list[np.ndarray]:
    """The DC-only thumbnails (one sample for each 8 x 8 block of the first component) of the images in ``data``."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        groups.setdefault((tuple(x.parts), tuple((x.tables[d], x.tables[a]) for d, a in x.use)), []).append(i)
    out: list = [None] * len(images)
    for (parts, use), members in groups.items():
        ends = np.cumsum([images[i].end - images[i].begin for i in members])
        for run in np.split(np.array(members), np.flatnonzero(np.diff(ends // STEP_BYTES)) + 1):
            for i, thumb in zip(run, _in_step(data, [images[i] for i in run], parts, use), strict=True):
                out[i] = thumb
    return out


def _in_step(data: np.ndarray, images: list[Image], parts: tuple, use: tuple) -> list[np.ndarray]:
    single = len(parts) == 1
    h, v = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    sequence = [k for k, p in enumerate(parts) for _ in range(1 if single else p[1] * p[2])]
    luma = sequence.count(0)
    wide = [-(-x.width // (8 * h)) for x in images]
    mcus = [w * -(-x.height // (8 * v)) for w, x in zip(wide, images, strict=True)]

    scans = np.concatenate([data[x.begin : x.end] for x in images])
    begins = np.concatenate([[0], np.cumsum([x.end - x.begin for x in images])])
    full = np.flatnonzero(scans[:-1] == 255)
    after = scans[full + 1]
    restarts = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(scans), bool)
    keep[full[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    stands = np.concatenate([[0], np.cumsum(keep)])
    starts = stands[np.sort(np.concatenate([begins[:-1], restarts + 2]))]
    padded = np.concatenate([scans[keep], np.full(8, 255, np.uint8)])
    ahead = np.zeros(len(padded) - 3, np.int64)
    for k in range(4):
        ahead <<= 8
        ahead |= padded[k : len(padded) - 3 + k]

    each = []
    for x, n in zip(images, mcus, strict=True):
        step = x.restart or n
        each += [min(step, n - k) for k in range(0, n, step)]
    left = np.array(each, np.int64)
    if len(left) != len(starts):
        raise ValueError("restart markers are missing")
    place = starts.astype(np.int64) * 8
    last = np.zeros((len(left), len(parts)), np.int64)
    most = int(left.max())
    found = np.zeros((len(left), most * luma), np.int64)
    top = len(ahead) - 1

    def peek(at: np.ndarray) -> np.ndarray:
        """24 bits or more, from the top of 32."""
        return ahead[np.minimum(at >> 3, top)] << (at & 7) & 0xFFFFFFFF

    even = int(left.min())
    for mcu in range(most):
        rows = slice(None) if mcu < even else np.flatnonzero(left > mcu)
        seen = 0
        for part in sequence:
            dc, ac = _table(use[part][0]), _table(use[part][1])
            at = place[rows]
            code = dc[peek(at) >> 16]
            at = at + (code >> 8)
            size = (code & 255).astype(np.int64)
            extra = peek(at) >> (32 - size)
            at = at + size
            value = last[rows, part] + np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
            last[rows, part] = value
            if part == 0:
                found[rows, mcu * luma + seen] = value
                seen += 1
            code_ = ac[peek(at) >> 16]
            at = at + (code_ >> 8)
            symbol = code_ & 255
            open_ = np.flatnonzero(symbol)
            if len(open_):
                k = np.ones(len(at), np.int64)
                while len(open_):
                    s = symbol[open_]
                    at[open_] += s & 15
                    k[open_] += (s >> 4) + 1
                    open_ = open_[k[open_] < 64]
                    code_ = ac[peek(at[open_]) >> 16]
                    at[open_] += code_ >> 8
                    symbol[open_] = code_ & 255
                    open_ = open_[(code_ & 255) > 0]
            place[rows] = at
    if (place[:-1] > starts[1:] * 8).any() or len(place) and place[-1] > (len(padded) - 8) * 8:
        raise ValueError("a scan ends too soon")

    thumbs, first = [], 0
    for x, w, n in zip(images, wide, mcus, strict=True):
        count = -(-n // (x.restart or n))
        blocks = np.concatenate([found[first + k, : left[first + k] * luma] for k in range(count)]) if count and left[first : first + count].min() < most else found[first : first + count].reshape(-1)
        first += count
        lh, lv = (1, 1) if single else parts[0][1:3]
        grid = blocks.reshape(n // w, w, lv, lh).transpose(0, 2, 1, 3).reshape(n // w * lv, w * lh)
        level = np.clip(np.rint(grid * x.quantum[parts[0][3]] / 8 + 128), 0, 255).astype(np.uint8)
        thumbs.append(level[: -(-x.height * lv // (8 * v)), : -(-x.width * lh // (8 * h))])
    return thumbs
