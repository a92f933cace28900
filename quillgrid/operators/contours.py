"""Contours of grids (r, c, z) as closed rings.

Every square of four cells, one of them above the level, gives up to two steps from an edge between
two cells to another, the higher ground on the left; cells that are missing, null or NaN are below, so
every contour closes. Steps are a permutation of the crossed edges: each ring's leader is
its least edge, and places within a ring count from there.

Squares go by tiles, and a tile follows its steps: rings that stay inside are done there, others leave it
as pieces, known by their first edge. Only pieces, at most one for each edge on the border of a tile, go on
to the doubling that finds the leaders and places of their rings. What is shuffled is the grid with the rims of its tiles and the
points of pieces, once; rounds are the logarithm of the pieces of the longest ring, and no ring has to fit a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.graph import accumulate
from quillgrid.session import apart, written

#: A square's corners, and its sides as (first corner, second corner), both going round.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
SIDES = ((0, 1), (1, 2), (2, 3), (3, 0))


def crossed(z: np.ndarray, there: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The steps in the squares of a tile of cells: (row, column) of each step's square, the side where a ring
    comes in and the one where it leaves. Squares of two opposite high corners join them if their mean is above the level."""
    n, m = z.shape[0] - 1, z.shape[1] - 1
    corner = [(slice(a, a + n), slice(b, b + m)) for a, b in CORNERS]
    high = [(there & (z > level))[k] for k in corner]
    saddle = (high[0] == high[2]) & (high[1] == high[3]) & (high[0] != high[1])
    joined = np.logical_and.reduce([there[k] for k in corner]) & (sum(z[k] for k in corner) > 4 * level)
    rises = [~high[a] & high[b] for a, b in SIDES]
    found = []
    for s, (a, b) in enumerate(SIDES):
        # going round a square, a ring comes in where ground falls below the level and leaves at the side where it
        # rises next, or, where two high corners are joined, at the one before
        turn = np.where(saddle, np.where(joined, 1, 3), np.where(rises[(s + 1) % 4], 1, np.where(rises[(s + 2) % 4], 2, 3)))
        i, j = np.nonzero(high[a] & ~high[b])
        found.append((i, j, np.full(len(i), s), (s + turn[i, j]) % 4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def followed(edge: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For steps in ascending order of their ``edge``: the step that their piece begins with, the number of steps from
    there, and whether the piece is a ring, which begins with its least edge."""
    n = len(edge)
    me = np.arange(n)
    at = np.minimum(np.searchsorted(edge, ahead), max(n - 1, 0))
    inside = edge[at] == ahead
    before, fed = me.copy(), np.zeros(n, bool)
    before[at[inside]], fed[at[inside]] = me[inside], True
    least, p = me, before
    for _ in range(n.bit_length()):
        least, p = np.minimum(least, least[p]), p[p]
    # what comes from no step without one before it goes round
    ring = fed[p]
    before = np.where(ring & (least == me), me, before)
    steps, p = (before != me).astype(np.int64), before
    for _ in range(n.bit_length()):
        steps, p = steps + steps[p], p[p]
    return p, steps, ring


def pieces(grid: DataFrame, level: float, tile: int = 256) -> DataFrame:
    """(piece, place, edge, next, x, y, area, open): ``steps`` by their places in pieces, which are ``open`` or
    whole rings. ``area`` is what a step adds to the ring's area."""
    # a square goes by its last corner, so that a grid that begins at 0 has no tile before
    at = lambda x, k: F.floor((F.col(x) + k) / tile).cast("long")
    seen = F.array_distinct(F.array(*(F.struct(at("r", a).alias("tr"), at("c", b).alias("tc")) for a in (0, 1) for b in (0, 1))))
    cells = grid.select("r", "c", F.col("z").cast("double").alias("z")).filter("z IS NOT NULL AND NOT isnan(z)").select("r", "c", "z", F.explode(seen).alias("_t"))
    local = lambda x, t: (F.col(x) - F.col(t) * tile + 1).cast("int")
    held = cells.select(F.col("_t.tr").alias("_tr"), F.col("_t.tc").alias("_tc"), local("r", "_t.tr").alias("_i"), local("c", "_t.tc").alias("_j"), "z")
    sides = np.array([[CORNERS[a], CORNERS[b]] for a, b in SIDES])

    def trace(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        i, j = cells["_i"].to_numpy(), cells["_j"].to_numpy()
        # no more of the tile than has cells, and a rim of missing ones
        low = [max(int(x.min()) - 1, 0) for x in (i, j)]
        size = [min(int(x.max()) + 1, tile) - a + 1 for x, a in zip((i, j), low, strict=True)]
        z, there = np.full(size, -np.inf), np.zeros(size, bool)
        np.maximum.at(z, (i - low[0], j - low[1]), cells["z"].to_numpy())
        there[i - low[0], j - low[1]] = True
        z[~there] = 0
        first = [int(key[k]) * tile - 1 + low[k] for k in (0, 1)]
        p, q, come, leave = crossed(z, there, level)

        def edge(side: np.ndarray) -> tuple[np.ndarray, ...]:
            """The edge as one number in order of row, column and direction; its higher cell, and how far from there the level is."""
            a, b = ((p + sides[side, k, 0], q + sides[side, k, 1]) for k in (0, 1))
            number = (np.minimum(a[0], b[0]) * size[1] + np.minimum(a[1], b[1])) * 2 + (a[1] == b[1])
            up = there[a] & (z[a] > level)
            up, down = (tuple(np.where(up, x, y) for x, y in zip(*ends, strict=True)) for ends in ((a, b), (b, a)))
            t = np.full(len(p), 0.5)
            np.divide(level - z[up], z[down] - z[up], out=t, where=there[down])
            return number, up[0], up[1], t * (down[0] - up[0]), t * (down[1] - up[1])

        (e, ei, ej, ey, ex), (f, fi, fj, fy, fx) = edge(come), edge(leave)
        x, x_next = ej + first[1] + ex, fj + first[1] + fx
        area = (x + x_next) * ((fi - ei) + (fy - ey)) / 2
        order = np.argsort(e)
        e, f = e[order], f[order]
        piece, place, ring = followed(e, f)
        out = {"place": place}
        for name, number in (("p", e[piece]), ("e", e), ("n", f)):
            out |= {f"{name}r": number // 2 // size[1] + first[0], f"{name}c": number // 2 % size[1] + first[1], f"{name}d": number % 2 == 1}
        out |= {"x": x[order], "y": (ei + first[0] + ey)[order], "area": area[order], "open": ~ring}
        # points of a piece beside each other take less room
        return pd.DataFrame(out).iloc[np.lexsort((place, piece))]

    kind = "place long, " + ", ".join(f"{n}r long, {n}c long, {n}d boolean" for n in "pen") + ", x double, y double, area double, open boolean"
    found = held.groupBy("_tr", "_tc").applyInPandas(trace, kind)
    whole = lambda n: F.struct(F.col(f"{n}r").alias("r"), F.col(f"{n}c").alias("c"), F.col(f"{n}d").alias("down"))
    return found.select(whole("p").alias("piece"), "place", whole("e").alias("edge"), whole("n").alias("next"), "x", "y", "area", "open")


def steps(grid: DataFrame, level: float) -> DataFrame:
    """(edge, next, x, y) of each crossed edge: the one that follows, and where the level is between its
    cells (half way where one is missing). An edge is (row, column, whether it goes down) of its first cell."""
    return pieces(grid, level).select("edge", "next", "x", "y")


def rings(grid: DataFrame, level: float, tile: int = 256) -> DataFrame:
    """(ring, place, edge, x, y, next, area): the points of every contour at ``level`` in order, the higher ground on one
    side; ``ring`` is the least edge, ``area`` what the step to the next point adds to the area."""
    at = written(pieces(grid, level, tile))
    points = at.filter("open")
    # a piece's least edge, and the piece and place where it stands
    least = F.min(F.struct("edge", "place"))
    met = points.groupBy("piece").agg(F.count("*").alias("n"), F.max(F.struct("place", "next"))["next"].alias("next"), least.alias("_l"))
    met = written(met.select("piece", "n", "next", F.struct("_l.edge", "piece", "_l.place").alias("least")))
    low = met.select("piece", "least", F.col("next").alias("p"))
    while True:
        ahead = low.select(F.col("piece").alias("p"), F.col("least").alias("_least"), F.col("p").alias("_p"))
        both = written(low.join(apart(ahead), "p").select("piece", F.least("least", "_least").alias("least"), F.col("_p").alias("p"), (F.col("_least") < F.col("least")).alias("_m")))
        low = both.drop("_m")
        if not both.filter("_m").head(1):
            break
    led = written(met.drop("least").join(apart(low.select("piece", "least")), "piece"))
    # rings are cut before the piece that holds their least edge; each piece ends where all up to it end
    ends = F.col("next") == F.col("least.piece")
    total = accumulate(led.select(F.col("piece").alias("cell"), F.when(~ends, F.col("next")).alias("receiver"), F.col("n").alias("value")))
    placed = written(led.join(apart(total.withColumnRenamed("cell", "piece")), "piece"))
    sizes = placed.filter(ends).select(F.col("next").alias("piece"), F.col("total").alias("_all"))
    told = placed.join(apart(sizes), "piece", "left").select("piece", F.col("least.edge").alias("ring"), (F.col("total") - F.col("n") - F.col("least.place")).alias("_first"), "_all")
    place = F.col("place") + F.col("_first")
    own = ["edge", "x", "y", "next", "area"]
    joined = points.join(apart(told), "piece").select("ring", F.when(place < 0, place + F.col("_all")).otherwise(place).alias("place"), *own)
    return at.filter("NOT open").select(F.col("piece").alias("ring"), "place", *own).unionByName(joined)


def areas(points: DataFrame) -> DataFrame:
    """(ring, points, area) of ``rings``: above 0 round high ground, below 0 round holes in it."""
    return points.groupBy("ring").agg(F.count("*").alias("points"), F.sum("area").alias("area"))
