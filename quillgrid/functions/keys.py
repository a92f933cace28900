"""Keyed hashing and draws as column expressions that are safe under ANSI mode.

64-bit values are BIGINTs read as unsigned. Sums and products wrap modulo 2^64
without ever overflowing a signed addition: they are put together from halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32, M64 = 0xFFFFFFFF, (1 << 64) - 1
#: The constants of splitmix64 and of FNV-1a with 64 bits.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def signed(value: int) -> int:
    """The BIGINT with the bits of an unsigned 64-bit integer."""
    value &= M64
    return value - (1 << 64) if value >> 63 else value


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32))


def add64(a: Column, b: Column) -> Column:
    low = _low(a) + _low(b)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def mul64(a: Column, constant: int) -> Column:
    """``a`` times a constant: 16-bit parts of the constant keep each product under 2^48."""
    low, high = _low(a), F.shiftrightunsigned(a, 32)
    c = [constant >> 16 * k & 0xFFFF for k in range(4)]
    base = add64(low * F.lit(c[0]), F.shiftleft(low * F.lit(c[1]), 16))
    cross = _low(low * F.lit(c[2])) + F.shiftleft((low * F.lit(c[3])).bitwiseAND(F.lit(0xFFFF)), 16)
    cross = cross + _low(high * F.lit(c[0])) + F.shiftleft((high * F.lit(c[1])).bitwiseAND(F.lit(0xFFFF)), 16)
    return add64(base, F.shiftleft(cross, 32))


def splitmix64(z: Column) -> Column:
    """One step of splitmix64. The value is spelled once for each stage through a
    one-element array, so that the expression stays linear in size."""

    def stage(x: Column, shift: int, constant: int | None) -> Column:
        def body(v: Column) -> Column:
            mixed = v.bitwiseXOR(F.shiftrightunsigned(v, shift))
            return mul64(mixed, constant) if constant is not None else mixed

        return F.transform(F.array(x), body)[0]

    z = add64(z, F.lit(signed(GOLDEN)))
    return stage(stage(stage(z, 30, MIX_1), 27, MIX_2), 31, None)


def splitmix64_int(z: int) -> int:
    z = (z + GOLDEN) & M64
    z = ((z ^ z >> 30) * MIX_1) & M64
    z = ((z ^ z >> 27) * MIX_2) & M64
    return z ^ z >> 31


def key(seed: int, parts: tuple) -> int:
    """The key of a seed and named parts; constant, so it is found on the driver."""
    h = FNV_OFFSET ^ splitmix64_int(seed & M64)
    for part in parts:
        for b in (*str(part).encode(), 0xFF):
            h = ((h ^ b) * FNV_PRIME) & M64
    return splitmix64_int(h)


def cell_key(seed: int, parts: tuple, cell: Column, draw: int = 0) -> Column:
    """Key of a cell, or of one numbered draw of it."""
    k = splitmix64(F.lit(signed(key(seed, parts))).bitwiseXOR(cell))
    return splitmix64(k.bitwiseXOR(F.lit(draw))) if draw else k


def to_unit(k: Column) -> Column:
    """Uniform in [0, 1) from the upper 53 bits."""
    return F.shiftrightunsigned(k, 11) / F.lit(float(1 << 53))


def unsigned_order(k: Column) -> Column:
    """Sorts BIGINTs as unsigned numbers."""
    return k.bitwiseXOR(F.lit(-(1 << 63)))


def poisson(u: Column, mean: Column) -> Column:
    """The count at ``u`` of a Poisson law: how many partial sums of p(0), p(1), ... are
    at ``u`` or under, from p(n) = p(n - 1) mean / n. Sums stop 12 deviations and 30
    beyond the mean, past which a double has no room, so no tail is cut. Means go up to
    700, where exp(-mean) still is a normal number; null beyond, and zero at or below 0."""
    stop = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    begin = F.exp(-mean)

    def more(s: Column, n: Column) -> Column:
        p = s["p"] * mean / n
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + F.when(s["c"] + p <= u, 1).otherwise(0)).alias("k"))

    first = F.struct(begin.alias("p"), begin.alias("c"), F.when(begin <= u, 1).otherwise(0).alias("k"))
    count = F.aggregate(F.sequence(F.lit(1), stop), first, more, lambda s: s["k"].cast("long"))
    return F.when(mean <= 0, F.lit(0).cast("long")).when(mean <= 700, count)
