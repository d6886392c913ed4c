"""Scalar and binary quantisation of array columns, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinal.functions.distance import Vector, vec

FLAT = 1e-12


def scalar_quantize(v: Vector, bits: int = 8) -> Column:
    """Struct (codes, lo, hi): each element scaled to 0 .. 2**bits - 1 between the vector's own bounds, halves to even.

    A vector of one value has codes 0; an empty one no codes and bounds 0.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    v = vec(v)
    lo, hi = F.coalesce(F.array_min(v), F.lit(0.0)), F.coalesce(F.array_max(v), F.lit(0.0))
    top = float(2**bits - 1)
    codes = F.when(hi - lo <= FLAT, F.transform(v, lambda x: F.lit(0))).otherwise(F.transform(v, lambda x: F.rint((x - lo) / (hi - lo) * top).cast("int")))
    return F.struct(codes.alias("codes"), lo.alias("lo"), hi.alias("hi"))


def scalar_dequantize(q: Column, bits: int = 8) -> Column:
    top = float(2**bits - 1)
    return F.transform(q["codes"], lambda c: q["lo"] + c.cast("double") * (q["hi"] - q["lo"]) / top)


def binary_quantize(v: Vector) -> Column:
    """Bytes (as an array of int): bit 1 where an element is above 0, the first element highest, the last byte filled with 0."""
    v = vec(v)
    n_bytes = F.ceil(F.size(v) / 8).cast("int")
    at = lambda i: F.when(F.coalesce(F.get(v, i), F.lit(0.0)) > 0, F.lit(1)).otherwise(F.lit(0))
    byte = lambda b: sum((at(b * 8 + j) * (1 << (7 - j)) for j in range(1, 8)), at(b * 8) * 128)
    return F.when(n_bytes == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n_bytes - 1), byte))


def binary_dequantize(code: Column, dimension: int) -> Column:
    """+1 and -1; places beyond the code are -1."""
    if dimension <= 0:
        return F.array().cast("array<double>")
    bit = lambda i: F.shiftright(F.coalesce(F.get(code, F.floor(i / 8).cast("int")), F.lit(0)), 0)
    one = lambda i: F.floor(bit(i) / F.pow(F.lit(2.0), 7 - i % 8)) % 2 == 1
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(one(i), F.lit(1.0)).otherwise(F.lit(-1.0)))


def hex_code(code: Column) -> Column:
    """Bytes as lowercase hex."""
    return F.lower(F.array_join(F.transform(code, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def hamming_bytes(a: Column, b: Column) -> Column:
    """Differing bits; each byte that one side lacks counts eight."""
    n = F.least(F.size(a), F.size(b))
    common = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(common, F.lit(0), lambda s, x: s + x) + 8 * F.abs(F.size(a) - F.size(b))
