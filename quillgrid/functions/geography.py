"""Places on a flat world map in metres, sample hashes, and small numeric maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
#: The multipliers of the published 32-bit "lowbias32" mix, and those
#: that spread rows and columns before it.
MIX_A, MIX_B, SPREAD_I, SPREAD_J = 0x7FEB352D, 0x846CA68B, 0x9E3779B1, 0x85EBCA77


@dataclass(frozen=True)
class World:
    """Bounds in metres and the number of rows and columns; ``round`` if longitude wraps."""

    x0: float
    y0: float
    x1: float
    y1: float
    rows: int
    cols: int
    round: bool = True

    def latitude(self, y: Column) -> Column:
        """Degrees, from 90 at the upper bound (least y) to -90."""
        return 90 - (y - self.y0) / (self.y1 - self.y0) * 180

    def clip(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Within the bounds; a round world keeps its longitude unwrapped."""
        within = lambda v, a, b: F.least(F.greatest(v, F.lit(a)), F.lit(b))
        return x if self.round else within(x, self.x0, self.x1), within(y, self.y0, self.y1)

    def cell(self, x: Column, y: Column) -> Column:
        """The cell of a place: columns wrap or are held, rows are held."""
        col = F.floor((x - self.x0) / ((self.x1 - self.x0) / self.cols))
        row = F.floor((y - self.y0) / ((self.y1 - self.y0) / self.rows))
        hold = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
        col = F.pmod(col, F.lit(self.cols)) if self.round else hold(col, self.cols)
        return (hold(row, self.rows) * self.cols + col).cast("long")

    def centre(self, cell: Column) -> tuple[Column, Column]:
        col = cell % self.cols
        row = (cell - col) / self.cols
        return self.x0 + (col + 0.5) * ((self.x1 - self.x0) / self.cols), self.y0 + (row + 0.5) * ((self.y1 - self.y0) / self.rows)


def climate_latitude(y: Column) -> Column:
    """Degrees by the flat climate convention: 10,000 km to a quarter."""
    return F.greatest(F.least(-y * 90 / 10_000_000, F.lit(90.0)), F.lit(-90.0))


def stretched(v: Column, from_bound: float, to_bound: float) -> Column:
    """A coordinate of a world of one size in the atlas of another."""
    return v * (to_bound / from_bound)


def mul32(a: Column, constant: int) -> Column:
    """Product modulo 2^32 of a number under 2^32: by halves of the constant, so that no step passes 2^49."""
    low, high = constant & 0xFFFF, constant >> 16
    return (a * F.lit(low) + F.shiftleft((a * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def mix32(x: Column) -> Column:
    """The published 32-bit mix of shifts 16, 15, 16."""
    def stage(x: Column, shift: int, factor: int) -> Column:
        # through an array of one, so that each stage is worked out once
        return F.transform(F.array(x), lambda v: mul32(v.bitwiseXOR(F.shiftrightunsigned(v, shift)), factor))[0]

    return stage(stage(stage(x, 16, MIX_A), 15, MIX_B), 16, 1)


def sample_hash(i: Column, j: Column, salt: Column | int) -> Column:
    """A 32-bit hash of a place on a lattice."""
    low = lambda v: v.cast("long").bitwiseAND(F.lit(M32))
    return mix32(mul32(low(i), SPREAD_I).bitwiseXOR(mix32((low(j) + SPREAD_J).bitwiseAND(F.lit(M32)))).bitwiseXOR(salt if isinstance(salt, Column) else F.lit(salt)))


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def height_km(e: Column) -> Column:
    """Ocean linear to -10 km, land by a flat-footed quintic to 6 km at 1."""
    t = F.least(e, F.lit(1.0))
    return F.when(e <= 0, e * 10).otherwise(6 * F.pow(t, F.lit(4)) * (5 - 4 * t))


def quantised(weight: Column, top: Column, bits: int = 20) -> Column:
    """Weights as integers up to 2^bits of the greatest; what is above zero stays so."""
    part = F.floor(weight / top * (1 << bits)).cast("long")
    return F.when((weight > 0) & (top > 0), F.greatest(part, F.lit(1))).otherwise(F.lit(0)).cast("long")


def colour(hex_text: str) -> list[float]:
    return [int(hex_text[k : k + 2], 16) / 255 for k in (0, 2, 4)]


def ramp(t: Column, stops: Sequence[str]) -> list[Column]:
    """Red, green and blue of a ramp of equally spaced 'rrggbb' stops at ``t`` in [0, 1]."""
    at = F.least(F.greatest(F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    k = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    table = [F.array(*(F.lit(colour(s)[c]) for s in stops)) for c in range(3)]
    return [x[k] * (1 - (at - k)) + x[k + 1] * (at - k) for x in table]
