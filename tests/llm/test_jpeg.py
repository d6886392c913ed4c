"""Frames of other writers than ours, made coefficient by coefficient and sample by sample."""

import struct

import numpy as np
import pytest

from vicinal.llm import avi, jpeg

#: 128 symbols of eight bits, 128 of nine.
COUNTS = bytes([0] * 7 + [128, 128] + [0] * 7)
CODE = {s: f"{s:08b}" if s < 128 else f"{(128 << 1) + s - 128:09b}" for s in range(256)}


def segment(kind, body):
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def number(v):
    size = abs(v).bit_length()
    return size, f"{v if v >= 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def joined(parts):
    return b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts))


def baseline(rng, width, height, sampling, restart):
    """(frame, expected samples of the first component)."""
    quant = rng.integers(1, 6, 64)
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    h0, v0 = sampling[0]
    plane = np.zeros((high * v0 * 8, wide * h0 * 8))
    parts, bits, dc = [], "", [0] * len(sampling)
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            parts, bits, dc = [*parts, packed(bits)], "", [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for j in range(v):
                for i in range(h):
                    block = np.where(rng.random(64) < 0.1, rng.integers(-40, 41, 64), 0)
                    block[0] = rng.integers(-60, 60)
                    size, extra = number(int(block[0]) - dc[c])
                    dc[c] = int(block[0])
                    bits += CODE[size] + extra
                    run = 0
                    for x in block[1:].tolist():
                        if not x:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + CODE[0xF0], run - 16
                        size, extra = number(x)
                        bits, run = bits + CODE[run << 4 | size] + extra, 0
                    if run:
                        bits += CODE[0]
                    if c == 0:
                        square = np.zeros(64)
                        square[jpeg.ZIGZAG] = block * quant
                        square = square.reshape(8, 8)
                        y, x = (unit // wide * v0 + j) * 8, (unit % wide * h0 + i) * 8
                        for a in range(8):
                            for b in range(8):
                                at = [(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * a + 1) * u * np.pi / 16) for u in range(8)]
                                to = [(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * b + 1) * u * np.pi / 16) for u in range(8)]
                                plane[y + a, x + b] = np.array(at) @ square @ np.array(to) + 128
    parts.append(packed(bits))
    frame = b"\xff\xd8" + segment(0xDB, bytes([0, *quant.tolist()])) + segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    frame += b"".join(segment(0xC4, bytes([t]) + COUNTS + bytes(range(256))) for t in (0x00, 0x10)) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    frame += segment(0xDA, bytes([len(sampling), *[x for c in range(len(sampling)) for x in (c + 1, 0)], 0, 63, 0])) + joined(parts) + b"\xff\xd9"
    return frame, np.clip(np.rint(plane), 0, 255)[:height, :width]


@pytest.mark.parametrize("sampling, restart", [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 1)])
def test_baseline_frames(sampling, restart):
    frame, want = baseline(np.random.default_rng(1), 37, 21, sampling, restart)
    got = jpeg.decode(frame)
    assert got.shape == (21, 37) and np.abs(got.astype(int) - want).max() <= 1


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("restart", [0, 26])
def test_lossless_frames(predictor, restart):
    rng = np.random.default_rng(predictor)
    x = rng.integers(0, 256, (9, 13))
    parts, bits, top = [], "", 0
    for k in range(x.size):
        i, j = divmod(k, 13)
        if restart and k and k % restart == 0:
            parts, bits, top = [*parts, packed(bits)], "", i
        a, b, c = int(x[i, j - 1]), int(x[i - 1, j]), int(x[i - 1, j - 1])
        guess = 128 if (i, j) == (top, 0) else a if i == top else b if j == 0 else (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor]
        size, extra = number(int(x[i, j]) - guess)
        bits += CODE[size] + extra
    frame = b"\xff\xd8" + segment(0xC3, struct.pack(">BHHB", 8, 9, 13, 1) + bytes([1, 0x11, 0])) + segment(0xC4, bytes([0]) + COUNTS + bytes(range(256)))
    frame += (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + joined([*parts, packed(bits)]) + b"\xff\xd9"
    assert (jpeg.decode(frame) == x).all()


def test_own_frames_and_files_of_other_frames():
    x = np.random.default_rng(3).integers(0, 256, (2, 576), np.uint8)
    frames = avi.encode_frames(x)
    assert all((jpeg.decode(f).reshape(-1) == row).all() for f, row in zip(frames, x))
    other = [baseline(np.random.default_rng(i), 16, 16, [(1, 1)], 0)[0] for i in range(3)]
    again, _, _ = avi.read_avi(avi.write_avi(other, 0))
    assert again == other and avi.decode_frames(again).shape == (3, 256)


def test_broken_frames():
    frame, _ = baseline(np.random.default_rng(1), 16, 16, [(1, 1)], 0)
    for bad in (b"", frame[:20], frame.replace(b"\xff\xc0", b"\xff\xc2"), frame[: frame.index(b"\xff\xda") + 12] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
