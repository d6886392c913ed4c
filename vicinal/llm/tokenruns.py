"""Word sequences of byte texts (pure numpy): words and their places, path fragments of equal minimiser, digests of runs of words.

The polynomial hashes here only choose minimisers, where a collision costs time and no result. What tells words apart is a
cryptographic digest of their bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the polynomial hashes (any odd 64-bit constants do) and the finisher's.
_BYTE, _WORD, _SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_BYTES = 1 << 20
CHUNK_WORDS = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    up, down = _POWERS.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) <= n:
        size = 1 << (n + 1).bit_length()
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        up = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = pow(base, -1, 1 << 64)
        down = np.cumprod(steps, dtype=np.uint64)
        _POWERS[base] = up, down
    return up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of one byte text, in order. Long texts are worked off in chunks."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + CHUNK_BYTES)
        if end < n:  # cut where a space is: back from the end, else onwards
            spaces = np.flatnonzero(_IS_SPACE[text[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                while end < n and not _IS_SPACE[text[end]]:
                    end += 1
        out.append(_hash_chunk(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _hash_chunk(b: np.ndarray) -> np.ndarray:
    inside = ~_IS_SPACE[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    up, down = _powers(_BYTE, len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return _mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_SECOND))


class Runs:
    """Prefix sums over a chunk of word hashes, from which any run's hash follows."""

    def __init__(self, words: np.ndarray, base: int = _WORD):
        up, self.down = _powers(base, len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Of the runs words[start : start + length]."""
        raw = (self.sums[starts + lengths] - self.sums[starts]) * self.down[starts]
        return _mix(raw + np.asarray(lengths).astype(np.uint64) * np.uint64(_SECOND))


@dataclass
class Words:
    """A text's words ``[^\\x20\\x09-\\x0D]+`` joined by one space, and where each begins and ends."""

    joined: bytes
    start: np.ndarray
    end: np.ndarray

    def run(self, first: int, n: int) -> bytes:
        """n words from the first on; fewer where the text ends."""
        last = min(first + n, len(self.start)) - 1
        return self.joined[self.start[first] : self.end[last]]

    def digests(self, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """16-byte digests of runs of words."""
        text, digest = self.joined, hashlib.blake2b
        return [digest(text[a:b], digest_size=16).digest() for a, b in zip(self.start[first].tolist(), self.end[first + n - 1].tolist())]


def words_of(text: bytes | None) -> Words:
    joined = b" ".join((text or b"").split())
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if not joined:
        return Words(b"", spaces, spaces)
    return Words(joined, np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(joined)])))


@dataclass
class Fragments:
    """Maximal runs of consecutive windows with one minimiser: first word, number of windows, minimiser."""

    start: np.ndarray
    windows: np.ndarray
    minimiser: np.ndarray


def fragments(words: np.ndarray, window: int, k: int) -> Fragments:
    """Path fragments of one text's word hashes. Every window (edge) of the text is in exactly one fragment."""
    parts = []
    n = len(words) - window + 1
    for at in range(0, max(n, 0), CHUNK_WORDS):
        parts.append(_fragments(words[at : at + CHUNK_WORDS + window - 1], at, window, k))
    if not parts:
        e = np.empty(0, np.int64)
        return Fragments(e, e, np.empty(0, np.uint64))
    return Fragments(*[np.concatenate(x) for x in zip(*parts)])


def _fragments(words: np.ndarray, at: int, window: int, k: int) -> tuple:
    n = len(words) - window + 1
    low = Runs(words).hash(np.arange(len(words) - k + 1), k)
    width, size = window - k + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    least = np.minimum(low[:n], low[width - size : width - size + n])
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return start + at, np.diff(np.concatenate((start, [n]))), least[start]
