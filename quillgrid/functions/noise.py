"""Keyed noise as column expressions: the same value at a place whatever is asked beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from math import sqrt
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import geography, keys, lattice

#: What layers, octaves and components add to a salt; the spread of a sum of octaves.
SALT_LAYER, SALT_OCTAVE, SALT_PART, SALT_BASE = 0x632BE5AB, 0x27D4EB2D, 0x165667B1, 64
SPREAD = 0.45


def blend(corners: dict, ux: Column, uy: Column) -> Column:
    """Values at (0, 0), (1, 0), (0, 1), (1, 1) weighted by how near they are."""
    return sum((ux if a else 1 - ux) * (uy if b else 1 - uy) * v for (a, b), v in corners.items())


def value_noise(seed: int, name: str, lod: int, x: Column, y: Column, west: float, width: float) -> Column:
    """Keyed values in [-1, 1) at the nodes of level ``lod``, joined by the smooth cubic. A whole
    number of cells goes round the world of ``width`` metres from ``west``, so it wraps."""
    size = lattice.NATIVE_M * 2.0**lod
    period = max(1, round(width / size))
    half = period // 2
    gx, gy = (x - west) / width * period - half - 0.5, y / size - 0.5
    place = F.struct(F.floor(gx).alias("i"), F.floor(gy).alias("j"), (gx - F.floor(gx)).alias("x"), (gy - F.floor(gy)).alias("y"))

    def at(p: Column) -> Column:
        key = lambda a, b: keys.cell_key(seed, ("resources", "noise", name, f"lod{lod}"), lattice.cell_id(F.lit(lod), F.pmod(p["i"] + a + half, F.lit(period)) - half, p["j"] + b))
        corners = {(a, b): 2 * keys.to_unit(key(a, b)) - 1 for a in (0, 1) for b in (0, 1)}
        return blend(corners, geography.smoothstep(0, 1, p["x"]), geography.smoothstep(0, 1, p["y"]))

    return F.transform(F.array(place), at)[0]


def salt(seed: int, layer: int, octave: int, part: int = 0) -> int:
    """The salt of an octave of a layer; constant, so it is found on the driver."""
    v = (seed + layer * SALT_LAYER + (octave + SALT_BASE) * SALT_OCTAVE + part * SALT_PART) & keys.M32
    for shift, factor in ((16, geography.MIX_A), (15, geography.MIX_B), (16, 1)):
        v = (v ^ v >> shift) * factor & keys.M32
    return v


class Octave(NamedTuple):
    """One term of a sum of octaves: its level, what its value in [-1, 1) is multiplied by, its salt."""

    level: int
    weight: float
    salt: int


def wavelength(level: int) -> float:
    return lattice.NATIVE_M * 2.0**level


def octaves(seed: int, layer: int, levels: Iterable[int], weight: Callable[[int], float], part: int = 0) -> list[Octave]:
    """The terms for ``levels``, weighted by a rule of the level."""
    return [Octave(level, weight(level), salt(seed, layer, level, part)) for level in levels]


def by_wavelength(share: float) -> Callable[[int], float]:
    """Weights that move samples by a share of each octave's wavelength."""
    return lambda level: share * wavelength(level)


def by_decay(decay: float, levels: Sequence[int]) -> Callable[[int], float]:
    """Weights that fall by 2^decay for each level down, over the spread of the sum of all ``levels``."""
    top = max(levels)
    spread = SPREAD * sqrt(sum(4.0 ** (decay * (level - top)) for level in levels))
    return lambda level: 2.0 ** (decay * (level - top)) / spread


def summed(terms: Sequence[Octave], i: Column, j: Column, lod: int, moved: tuple[Column, Column] | None = None) -> Column:
    """The sum of ``terms`` at samples (i, j) of level ``lod``, moved by metres if asked, in doubles.

    A sample stands in the middle of its cell; an octave's values are at the corners of its
    own cells and joined by the quintic curve. All terms are one array folded by one expression, so
    the plan does not grow with them; ``moved`` should be columns of the table.
    """
    if not terms:
        return F.lit(0.0)
    table = F.array(*(F.struct(F.lit(t.level - lod).alias("up"), F.lit(1 / wavelength(t.level)).alias("per"), F.lit(t.weight).alias("weight"), F.lit(t.salt).cast("long").alias("salt")) for t in terms))
    quintic = lambda t: t * t * t * (t * (t * 6 - 15) + 10)

    def place(t: Column, x: Column, metres: Column | None) -> tuple[Column, Column]:
        """The octave's cell below a sample and how far into it the sample stands."""
        cells = F.pow(F.lit(2.0), F.greatest(t["up"], F.lit(0)))
        into = F.when(t["up"] > 0, (F.pmod(x.cast("double"), cells) + 0.5) / cells).otherwise(0.5)
        into = into if metres is None else into + metres * t["per"]
        return (F.floor(x / cells) + F.floor(into)).cast("long"), into - F.floor(into)

    def placed(t: Column) -> Column:
        (ci, x), (cj, y) = place(t, i, moved and moved[0]), place(t, j, moved and moved[1])
        return F.struct(ci.alias("i"), cj.alias("j"), quintic(x).alias("x"), quintic(y).alias("y"), t["weight"].alias("weight"), t["salt"].alias("salt"))

    def value(p: Column) -> Column:
        unit = lambda h: F.shiftrightunsigned(h, 8) / F.lit(float(1 << 23)) - 1
        return p["weight"] * blend({(a, b): unit(geography.sample_hash(p["i"] + a, p["j"] + b, p["salt"])) for a in (0, 1) for b in (0, 1)}, p["x"], p["y"])

    return F.aggregate(F.transform(F.transform(table, placed), value), F.lit(0.0), lambda total, v: total + v)
