"""AVI motion-JPEG containers in plain numpy: writing and reading RIFF indexes, and coding intra frames without loss.

Frames written here are 24 x 24 grey lossless JPEGs (process SOF3, 8 bits, predictor 1). The Huffman code of a difference of s bits has
9 - s bits, so every sample takes exactly nine bits and whole batches of frames are coded and decoded by array operations.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from vicinal.llm import jpeg

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
_SCAN = FRAME * 9 // 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_SOF3 = _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
_DHT = _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
_SOS = _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
HEAD = b"\xff\xd8" + _SOF3 + _DHT + _SOS
TAIL = b"\xff\xd9"


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(code of each difference from -255 on, difference of each nine-bit code)."""
    codes, values = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        extra = d if d > 0 else d + (1 << s) - 1
        codes[d + 255] = prefix << s | extra
        values[codes[d + 255]] = d
    return codes, values


_CODES, _VALUES = _code_tables()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEGs of an array (frames, FRAME) of bytes."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODES[d + 255].reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] & ((1 << k) - 1)) << (8 - k) | c[:, k] >> (k + 1)
    out[:, 8] = c[:, 7] & 0xFF
    raw = out.tobytes()
    return [HEAD + raw[i : i + _SCAN].replace(b"\xff", b"\xff\x00") + TAIL for i in range(0, len(raw), _SCAN)]


@dataclass(frozen=True)
class Jpeg:
    """What the marker segments before a scan say."""

    process: int
    width: int
    height: int
    predictor: int
    nine_bits: bool
    scan_at: int


_KNOWN: dict[bytes, Jpeg] = {}


def parse_jpeg(frame: bytes) -> Jpeg:
    """Walk the marker segments up to the scan. Raises ValueError on what isn't a JPEG."""
    if (known := _KNOWN.get(frame[: len(HEAD)])) is not None:
        return known
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, process, width, height, nine = 2, -1, 0, 0, False
    while at + 4 <= len(frame):
        mark, kind, length = struct.unpack_from(">BBH", frame, at)
        if mark != 0xFF:
            raise ValueError("no marker where one is due")
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            process, height, width = kind, *struct.unpack(">HH", body[1:5])
        elif kind == 0xC4:
            nine = _segment(kind, body) == _DHT
        elif kind == 0xDA:
            found = Jpeg(process, width, height, body[3], nine, at)
            if at == len(HEAD):
                _KNOWN[frame[:at]] = found
            return found
    raise ValueError("no scan")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, pixels). Frames as written here are decoded together by array operations, others one by one (see ``jpeg``)."""
    try:
        return _decode_own(frames)
    except _OtherFrames:
        found = [jpeg.decode(frame) for frame in frames]
    if len({x.shape for x in found}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack([x.reshape(-1) for x in found])


class _OtherFrames(Exception):
    """Frames that were not written here."""


def _decode_own(frames: list[bytes]) -> np.ndarray:
    scans = []
    for frame in frames:
        head = parse_jpeg(frame)
        if (head.process, head.width, head.height, head.predictor, head.nine_bits) != (0xC3, SIDE, SIDE, 1, True):
            raise _OtherFrames
        scan = frame[head.scan_at : frame.rindex(TAIL)].replace(b"\xff\x00", b"\xff")
        if len(scan) != _SCAN:
            raise _OtherFrames
        scans.append(scan)
    b = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        c[:, k] = (b[:, k] & ((1 << (8 - k)) - 1)) << (k + 1) | b[:, k + 1] >> (7 - k)
    d = _VALUES[c].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(-1, FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(frames: list[bytes], n_bytes: int) -> bytes:
    """An AVI file of JPEG frames with an index; ``n_bytes`` (the length without padding) is kept in a chunk of its own."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks, index, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        chunks.append(chunk)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(chunk)
    body = hdrl + _chunk(b"plen", struct.pack("<Q", n_bytes)) + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def read_avi(media: bytes) -> tuple[list[bytes], int, float]:
    """(frames by the file's index, unpadded length or -1, frames a second). Raises ValueError on what isn't an AVI."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, length, fps = 12, -1, b"", -1, float(FPS)
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            inner = media[at + 12 : at + 8 + size]
            if inner[:4] == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", inner, 8)[0])
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        elif name == b"plen":
            length = struct.unpack_from("<Q", media, at + 8)[0]
        at += 8 + size + (size & 1)
    if movi < 0:
        raise ValueError("no movi list")
    frames = []
    for name, _flags, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            start = movi + offset + 8
            if media[start - 8 : start - 4] != name:
                raise ValueError("index points beside a chunk")
            frames.append(media[start : start + size])
    return frames, length, fps


def shot_starts(samples: np.ndarray, bins: int = 16, window: int = 8, factor: float = 2.0, least: float = 0.1) -> list[int]:
    """First frame of each shot.

    A cut is where the histogram differs from the frame before by more than ``least`` (of all samples) and by more than the mean
    plus ``factor`` standard deviations of the last ``window`` differences. The first difference has none before it: ``least``
    alone decides.
    """
    n = len(samples)
    if n == 0:
        return []
    keys = (samples >> (8 - (bins.bit_length() - 1))).astype(np.int64) + np.arange(n)[:, None] * bins
    hist = np.bincount(keys.ravel(), minlength=n * bins).reshape(n, bins)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    c1, c2 = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    i = np.arange(len(diff))
    lo = np.maximum(0, i - window)
    k = np.maximum(1, i - lo)
    mean = (c1[i] - c1[lo]) / k
    spread = np.sqrt(np.maximum(0, (c2[i] - c2[lo]) / k - mean * mean))
    return [0, *(np.flatnonzero((diff > least) & (diff > mean + factor * spread)) + 1).tolist()]
