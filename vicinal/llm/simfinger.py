"""Vectorised SimHash fingerprints of whole texts (pure numpy, no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = bytes([32, *range(9, 14)])
_TO_SPACE = bytes(32 if b in _SPACES else b for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null gives none."""
    if not text:
        return []
    # bytes.split() cuts at exactly these six separators
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; fewer words give one whole-sequence shingle."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return np.array(hashes, np.uint64)


#: Odd constants that draw further words of bits from one hash (any will do), and the finisher's multipliers.
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows whose bits are summed in one byte.
_BYTE_ROWS = 240


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many rows of ``h`` (n, words) unsigned 64-bit have each bit set, lowest bit of the first word first."""
    total = np.zeros(h.shape[1] * 64, np.int64)
    for at in range(0, len(h), _BYTE_ROWS * 64):  # bounded memory on very long texts
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + _BYTE_ROWS * 64]).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), _BYTE_ROWS):
            total += bits[low : low + _BYTE_ROWS].sum(axis=0, dtype=np.uint8)
    return total


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes that follow from each hash of ``h``."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingle hashes; no words give 0."""
    h = shingle_hashes(ascii_words(text), width)
    if not len(h):
        return 0
    bits = (2 * bit_counts(h[:, None]) > len(h)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
