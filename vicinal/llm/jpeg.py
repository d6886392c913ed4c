"""Grey samples of JPEG intra frames of any size: baseline (process SOF0) and lossless (SOF3) with the frame's own tables.

Baseline frames may have several components and any sampling factors; what is returned is the first component, brightness.
Lossless frames have one component of eight bits. Restart intervals are followed. Frames without Huffman tables, and other
processes (progressive, arithmetic, twelve bits), raise ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

_BLOCK = 8


def _zigzag() -> list[int]:
    """Places of the coefficients in the order in which they are coded: along the diagonals, every other one turned."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[1] if sum(c) % 2 == 0 else c[0]))
    return [8 * i + j for i, j in cells]


ZIGZAG = _zigzag()
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    """What the marker segments say, and the scan's bytes in its restart intervals."""

    process: int = -1
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    scanned: list[int] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    restart: int = 0
    predictor: int = 0
    shift: int = 0
    intervals: list[bytes] = field(default_factory=list)


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) of the code that the next 16 bits begin with; length 0 where none does."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at, code = 0, 0
    for bits, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            lo, hi = code << (16 - bits), (code + 1) << (16 - bits)
            length[lo:hi], symbol[lo:hi] = bits, s
            code += 1
        at += count
        code <<= 1
    return length, symbol


def _intervals(data: bytes) -> list[bytes]:
    """A scan's bytes up to the next marker, cut at restart markers, without stuffed zeros."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        kind = data[at + 1] if 0 <= at < len(data) - 1 else 0xD9
        if at < 0 or kind != 0 and not 0xD0 <= kind <= 0xD7:
            out.append(data[begin : len(data) if at < 0 else at].replace(b"\xff\x00", b"\xff"))
            return out
        if kind:
            out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at + 2
        at += 2


def parse(raw: bytes) -> Frame:
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), 2
    while at + 4 <= len(raw):
        mark, kind, length = struct.unpack_from(">BBH", raw, at)
        if mark != 0xFF:
            raise ValueError("no marker where one is due")
        body = raw[at + 4 : at + 2 + length]
        at += 2 + length
        if kind == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                f.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                f.codes[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            bits, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            if kind not in (0xC0, 0xC3) or bits != 8 or not f.width or not f.height or kind == 0xC3 and n != 1:
                raise ValueError("only baseline and grey lossless frames of 8 bits are supported")
            f.process = kind
            f.components = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif kind == 0xDA:
            n = body[0]
            f.scanned = [body[1 + 2 * i] for i in range(n)]
            if f.process < 0 or set(f.scanned) != set(f.components):
                raise ValueError("a scan of all components is due")
            for i, c in enumerate(f.scanned):
                f.components[c].dc, f.components[c].ac = body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15
            f.predictor, f.shift = body[1 + 2 * n], body[3 + 2 * n] & 15
            f.intervals = _intervals(raw[at:])
            return f
    raise ValueError("no scan")


class _Bits:
    """Codes and numbers off one restart interval."""

    def __init__(self, data: bytes):
        bits = np.unpackbits(np.frombuffer(data + b"\xff" * 4, np.uint8)).astype(np.int64)
        n = len(bits) - 15
        self.ahead = sum(bits[i : i + n] << (15 - i) for i in range(16)).tolist()
        self.at = 0

    def code(self, table: tuple[list[int], list[int]]) -> int:
        if self.at >= len(self.ahead):
            raise ValueError("a scan ends early")
        ahead = self.ahead[self.at]
        if not table[0][ahead]:
            raise ValueError("bits that are no code")
        self.at += table[0][ahead]
        return table[1][ahead]

    def number(self, size: int) -> int:
        """A number of ``size`` bits; those that begin with 0 are negative."""
        if not size:
            return 0
        if self.at >= len(self.ahead):
            raise ValueError("a scan ends early")
        value = self.ahead[self.at] >> (16 - size)
        self.at += size
        return value if value >> (size - 1) else value - (1 << size) + 1


def _tables(f: Frame, used: set[int]) -> dict[int, tuple[list[int], list[int]]]:
    if not used <= f.codes.keys():
        raise ValueError("a frame without its Huffman tables")
    return {k: (f.codes[k][0].tolist(), f.codes[k][1].tolist()) for k in used}


def decode(raw: bytes) -> np.ndarray:
    """(height, width) samples of the first component."""
    f = parse(raw)
    return _lossless(f) if f.process == 0xC3 else _baseline(f)


def _baseline(f: Frame) -> np.ndarray:
    parts = [f.components[c] for c in f.scanned]
    if not {c.quant for c in parts} <= f.quants.keys():
        raise ValueError("a frame without its quantisers")
    tables = _tables(f, {c.dc for c in parts} | {c.ac for c in parts})
    across, down = max(c.h for c in parts), max(c.v for c in parts)
    if len(parts) == 1:  # a single component is not interleaved
        across = down = parts[0].h = parts[0].v = 1
    wide, high = -(-f.width // (8 * across)), -(-f.height // (8 * down))
    first = next(iter(f.components))
    kept = f.components[first]
    blocks = np.zeros((high * kept.v, wide * kept.h, 64), np.int64)
    bits, dc, left, interval = None, {}, 0, iter(f.intervals)
    for unit in range(wide * high):
        if bits is None or f.restart and not left:
            bits, dc, left = _Bits(next(interval, b"")), dict.fromkeys(f.scanned, 0), f.restart
        left -= 1
        y, x = divmod(unit, wide)
        for name, c in zip(f.scanned, parts):
            for v in range(c.v):
                for h in range(c.h):
                    block = [0] * 64
                    dc[name] += bits.number(bits.code(tables[c.dc]))
                    block[0] = dc[name]
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.code(tables[c.ac]), 16)
                        if not size and run < 15:
                            break
                        k += run
                        if k > 63:
                            raise ValueError("a block of too many coefficients")
                        block[ZIGZAG[k]] = bits.number(size)
                        k += 1
                    if name == first:
                        blocks[y * c.v + v, x * c.h + h] = block
    steps = np.zeros(64, np.int64)
    steps[ZIGZAG] = f.quants[kept.quant]
    square = (blocks * steps).reshape(*blocks.shape[:2], 8, 8).astype(float)
    samples = np.clip(np.rint(_COS.T @ square @ _COS) + 128, 0, 255).astype(np.uint8)
    plane = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    plane = plane.repeat(down // kept.v, axis=0).repeat(across // kept.h, axis=1)
    return plane[: f.height, : f.width]


def _lossless(f: Frame) -> np.ndarray:
    c = f.components[f.scanned[0]]
    table = _tables(f, {c.dc})[c.dc]
    rows = [[0] * f.width for _ in range(f.height)]
    bits, left, interval, top = None, 0, iter(f.intervals), 0
    for i in range(f.height):
        for j in range(f.width):
            if bits is None or f.restart and not left:
                bits, left, top = _Bits(next(interval, b"")), f.restart, i
                begin = (i, j)
            left -= 1
            size = bits.code(table)
            difference = 32768 if size == 16 else bits.number(size)
            a = rows[i][j - 1] if j else 0
            b = rows[i - 1][j] if i else 0
            d = rows[i - 1][j - 1] if i and j else 0
            if (i, j) == begin:
                guess = 1 << (7 - f.shift)
            elif i == top:
                guess = a
            elif j == 0:
                guess = b
            else:
                guess = (0, a, b, d, a + b - d, a + ((b - d) >> 1), b + ((a - d) >> 1), (a + b) >> 1)[f.predictor]
            rows[i][j] = (guess + difference) & 0xFFFF
    return (np.array(rows) << f.shift).astype(np.uint8)
