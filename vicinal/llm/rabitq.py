"""Randomised-rotation binary codes: unbiased inner-product estimates with confidence bounds (plain numpy).

A unit vector o is turned by a few random orthogonal matrices; each time it is reduced to the signs x of its entries, scaled to
unit length, and the correction factor f = <x, o> is stored. What the code says of o is x / f turned back: o itself plus an error
that is at right angles to o, of squared length 1 / f**2 - 1 and of random direction. So for two vectors the inner product of
what codes of *different* rotations say estimates <o, q> without bias, and the mean over all pairs of rotations has an error whose
spread follows from the stored factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Signs (n, rotations, d) as +1/-1 float32 and the correction factors (n, rotations)."""

    signs: np.ndarray
    factor: np.ndarray

    def take(self, at) -> Codes:
        return Codes(self.signs[at], self.factor[at])


def encode(turned: np.ndarray) -> Codes:
    """Codes of unit vectors (n, rotations, d), turned by each rotation."""
    signs = np.where(turned >= 0, np.float32(1), np.float32(-1))
    return Codes(signs, (np.abs(turned).sum(axis=2) / np.sqrt(turned.shape[2])).astype(np.float32))


def pack(codes: Codes) -> list[bytes]:
    """One byte string a vector: its signs, then its factors in single precision."""
    bits = np.packbits(codes.signs.reshape(len(codes.signs), -1) > 0, axis=1, bitorder="little")
    return [b.tobytes() + f.tobytes() for b, f in zip(bits, codes.factor.astype("<f4"))]


def unpack(packed: list[bytes], dim: int, rotations: int) -> Codes:
    n_bits = rotations * dim
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -(-n_bits // 8) + 4 * rotations)
    on = np.unpackbits(raw[:, : -4 * rotations], axis=1, count=n_bits, bitorder="little")
    factor = np.ascontiguousarray(raw[:, -4 * rotations :]).view("<f4")
    return Codes((on.astype(np.float32) * 2 - 1).reshape(-1, rotations, dim), factor)


class Told:
    """What codes say of their vectors, and how far that may be off for pairs of an inner product of ``threshold`` or more."""

    def __init__(self, codes: Codes, turns: np.ndarray, threshold: float):
        n, self.rotations, dim = codes.signs.shape
        said = np.einsum("nrd,rde->nre", codes.signs / (np.sqrt(dim) * codes.factor)[:, :, None], turns.astype(np.float32), optimize=True)
        total = said.sum(axis=1)
        self.left = np.concatenate([total, said.reshape(n, -1)], axis=1)
        self.right = np.concatenate([total, -said.reshape(n, -1)], axis=1)
        off = np.maximum(0, 1 / codes.factor.astype(np.float64) ** 2 - 1).sum(axis=1)
        free = max(1, dim - 1)
        self.alone = off / self.rotations**2 * (1 - threshold**2) / free
        self.both = off / (self.rotations * (self.rotations - 1) * np.sqrt(free))

    def take(self, at) -> Told:
        part = object.__new__(Told)
        part.rotations = self.rotations
        for name in ("left", "right", "alone", "both"):
            setattr(part, name, getattr(self, name)[at])
        return part


def estimate(one: Told, two: Told, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimates of the inner products of all of ``one`` with all of ``two``, bounds of their errors: ``eps`` standard deviations)."""
    guess = one.left @ two.right.T / np.float32(one.rotations * (one.rotations - 1))
    spread = one.alone[:, None] + two.alone[None, :] + one.both[:, None] * two.both[None, :]
    return guess, eps * np.sqrt(spread)
