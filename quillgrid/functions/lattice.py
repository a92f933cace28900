"""Addresses of quadtree cells: 5 bits lod + 16, 30 bits i + 2^29, 29 bits j + 2^28."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a cell of level 0, and the layout of a cell's id from its
#: highest bit down: level of detail, i, j, each with an offset that makes it positive.
NATIVE_M = 30.0


def cell_size(lod: Column | int) -> Column:
    return F.lit(NATIVE_M) * F.pow(F.lit(2.0), lod if isinstance(lod, Column) else F.lit(lod))


def cell_id(lod: Column, i: Column, j: Column) -> Column:
    head = F.shiftleft((lod + 16).cast("long"), 59)
    return head.bitwiseOR(F.shiftleft((i + (1 << 29)).cast("long"), 29)).bitwiseOR((j + (1 << 28)).cast("long"))


def decode_id(cell: Column) -> tuple[Column, Column, Column]:
    lod = F.shiftrightunsigned(cell, 59) - 16
    i = F.shiftrightunsigned(cell, 29).bitwiseAND(F.lit((1 << 30) - 1)) - (1 << 29)
    return lod, i, cell.bitwiseAND(F.lit((1 << 29) - 1)) - (1 << 28)


def parent(index: Column, up: int) -> Column:
    """Floor division by 2^up, of negative indices too."""
    return F.shiftright(index, up)


def block(index: Column, size: int) -> Column:
    """Floor division of a non-negative index."""
    return ((index - index % size) / size).cast("long")
