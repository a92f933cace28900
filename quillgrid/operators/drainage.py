"""Ways of water over grids: receivers across filled depressions and flats, and shared flow.

A cell drains to its steepest lower neighbour. Where there is none, two fronts run through the
flat: one from cells beside an equally high one that drains, one from cells beside higher
ground. With ``towards`` and ``away`` the steps of the fronts, cells drain to a neighbour of less
2 * towards - away: nearer to the way out, and away from the rim. A step nearer the way out lowers that by 1
at least, so nothing drains in a circle.

Fronts run tile by tile. A tile settles all its cells, then tells its neighbours which of its
border cells have come nearer, and only tiles that were told something run again: a flat takes
as many rounds as tile borders lie on its longest way, not cells, and a task holds tiles of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.graph import steepest_receivers
from quillgrid.operators.spatial import neighbours
from quillgrid.session import written

#: No distance yet.
FAR = 1 << 40
SHIFTS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


#: What a straight and a slanting step cost for each unit of both cells' costs together: ten and fourteen tenths of a mean.
STRAIGHT, SLANTING = 5, 7


def spread(zone: np.ndarray, there: np.ndarray, d: np.ndarray, cost: np.ndarray | None = None) -> np.ndarray:
    """Steps ``d`` carried on between neighbours of one zone until nothing changes; a rim of one
    cell is only read. A step counts 1, or with ``cost`` what both its cells cost by its length."""
    inner = (slice(1, -1), slice(1, -1))
    while True:
        best = d[inner].copy()
        for a, b in SHIFTS:
            beside = (slice(1 + a, zone.shape[0] - 1 + a), slice(1 + b, zone.shape[1] - 1 + b))
            joined = there[inner] & there[beside] & (zone[inner] == zone[beside])
            step = 1 if cost is None else (cost[inner] + cost[beside]) * (SLANTING if a and b else STRAIGHT)
            np.minimum(best, np.where(joined, d[beside] + step, FAR), out=best)
        if (best == d[inner]).all():
            return d
        d = d.copy()
        d[inner] = best


def fronts(cells: DataFrame, starts: list[str], tile: int = 64, costs: bool = False) -> DataFrame:
    """(r, c, *starts) of cells (r, c, zone, *starts): for each column the least number of steps
    of eight neighbours of one zone from a cell that has a value there, that value added; null
    where no front comes. With ``costs`` cells have a ``cost``, an integer not below 0, and steps count what they cost."""
    at = lambda x, k: F.floor((F.col(x) + k) / tile).cast("long")
    seen = F.array_distinct(F.array(*(F.struct(at("r", a).alias("tr"), at("c", b).alias("tc")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    known = [F.coalesce(F.col(s).cast("long"), F.lit(FAR)).alias(s) for s in starts]
    price = (F.col("cost") if costs else F.lit(0)).cast("long").alias("cost")
    held = cells.select("r", "c", F.col("zone").cast("long").alias("zone"), price, *known, F.explode(seen).alias("_t"))
    state = written(held.select("_t.tr", "_t.tc", "r", "c", "zone", "cost", *starts))
    news = written(state.select("tr", "tc", "r", "c", *starts).filter(" OR ".join(f"{s} < {FAR}" for s in starts)))
    names = ["tr", "tc", "r", "c", "zone", "cost", *starts, "moved"]
    kind = "tr long, tc long, r long, c long, zone long, cost long, " + ", ".join(f"{s} long" for s in starts) + ", moved boolean"

    def settle(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key
        size = (tile + 2, tile + 2)
        i, j = (own["r"] - tr * tile + 1).to_numpy(), (own["c"] - tc * tile + 1).to_numpy()
        zone, there = np.zeros(size, np.int64), np.zeros(size, bool)
        zone[i, j], there[i, j] = own["zone"], True
        cost = np.zeros(size, np.int64) if costs else None
        if costs:
            cost[i, j] = own["cost"]
        ti, tj = (told["r"] - tr * tile + 1).to_numpy(), (told["c"] - tc * tile + 1).to_numpy()
        out = own.copy()
        moved = np.zeros(len(own), bool)
        for s in starts:
            d = np.full(size, FAR)
            d[i, j] = own[s]
            np.minimum.at(d, (ti, tj), told[s].to_numpy())
            out[s] = spread(zone, there, d, cost)[i, j]
            # a tile's own cells that others hold too are told on; a first start is news as well
            moved |= (out[s] < own[s]).to_numpy()
        out["moved"] = moved & (out["r"] // tile == tr).to_numpy() & (out["c"] // tile == tc).to_numpy()
        return out[names]

    while news.head(1):
        woken = news.select("tr", "tc").distinct()
        run = state.join(woken, ["tr", "tc"], "left_semi").groupBy("tr", "tc").cogroup(news.groupBy("tr", "tc")).applyInPandas(settle, kind)
        ran = written(run)
        state = written(state.join(woken, ["tr", "tc"], "left_anti").unionByName(ran.drop("moved")))
        told = ran.filter("moved").select(F.col("tr").alias("_r"), F.col("tc").alias("_c"), "r", "c", *starts, F.explode(seen).alias("_t"))
        news = written(told.select("_t.tr", "_t.tc", "_r", "_c", "r", "c", *starts).filter("tr != _r OR tc != _c").drop("_r", "_c"))
    own = state.filter((F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc")))
    return own.select("r", "c", *(F.when(F.col(s) < FAR, F.col(s)).alias(s) for s in starts))


def cheapest(cells: DataFrame, tile: int = 64) -> DataFrame:
    """(cell, distance, previous) of cells (cell, r, c, cost, start): the least cost of a way over the cells
    that there are from any with ``start``, and the cell before on such a way, ties by
    direction; null where no way leads, previous also at starts. Costs are integers above 0, so that ways are exact
    and make no circle; places without a cell are not crossed."""
    at = written(cells.select("cell", "r", "c", F.col("cost").cast("long").alias("cost"), F.when(F.col("start"), 0).cast("long").alias("distance"), F.lit(0).alias("zone")))
    far = written(at.drop("distance").join(fronts(at, ["distance"], tile, costs=True), ["r", "c"]))
    offers = neighbours(far.filter("distance IS NOT NULL"), "r", "c", ["cell", "cost", "distance"]).withColumnsRenamed({"cell": "_from", "cost": "_cost", "distance": "_distance"})
    step = (F.col("cost") + F.col("_cost")) * F.when(F.col("dir") % 2 == 0, STRAIGHT).otherwise(SLANTING)
    back = far.join(offers, (far["r"] == offers["_r"]) & (far["c"] == offers["_c"])).filter(F.col("_distance") + step == F.col("distance"))
    back = back.groupBy("cell").agg(F.min(F.struct("dir", "_from"))["_from"].alias("previous"))
    return far.select("cell", "distance").join(back, "cell", "left")


def receivers(surface: DataFrame, tile: int = 64) -> DataFrame:
    """(cell, receiver) of a surface (cell, r, c, z, outlet); null at outlets, and for cells of
    which no way leads down (pits that were not filled)."""
    steep = steepest_receivers(surface.select("cell", "r", "c", "z")).withColumnRenamed("receiver", "_down")
    at = written(surface.join(steep, "cell").select("cell", "r", "c", "z", "outlet", F.when(~F.col("outlet"), F.col("_down")).alias("_down")))
    flat = F.col("_down").isNull() & ~F.col("outlet")
    offers = neighbours(at.withColumn("_flat", flat), "r", "c", ["cell", "z", "_flat"]).withColumnsRenamed({"cell": "_from", "z": "_z", "_flat": "_also"})
    met = at.filter(flat).join(offers, (at["r"] == offers["_r"]) & (at["c"] == offers["_c"])).select("cell", "r", "c", "z", "_from", "_z", "_also", "dir")
    met = written(met)
    level = F.col("z") == F.col("_z")
    edges = met.groupBy("cell", "r", "c", F.col("z").alias("zone")).agg(F.min(F.when(level & ~F.col("_also"), 1)).alias("towards"), F.min(F.when(F.col("_z") > F.col("z"), 1)).alias("away"))
    steps = fronts(edges, ["towards", "away"], tile)
    mask = edges.select("cell", "r", "c").join(steps, ["r", "c"]).filter("towards IS NOT NULL").select("cell", (2 * F.col("towards") - F.coalesce("away", F.lit(0))).alias("mask"))
    mask = written(mask)
    other = mask.select(F.col("cell").alias("_from"), F.col("mask").alias("_mask"))
    ways = met.filter(level).join(mask, "cell").join(other, "_from", "left")
    # beside the flat first, then the least mask, straight before slanting, then by direction
    ways = ways.filter(~F.col("_also") | (F.col("_mask") < F.col("mask")))
    best = F.min(F.struct(F.when(F.col("_also"), 1).otherwise(0).alias("in"), F.when(F.col("_also"), F.col("_mask")).alias("m"), (F.col("dir") % 2).alias("slant"), "dir", "_from"))
    chosen = ways.groupBy("cell").agg(best.alias("k")).select("cell", F.col("k._from").alias("_over"))
    return at.join(chosen, "cell", "left").select("cell", F.coalesce("_down", "_over").alias("receiver"))


def pushed(z: np.ndarray, own: np.ndarray, q: np.ndarray, exponent: float) -> np.ndarray:
    """What has passed through each cell when ``q`` has run down to lower neighbours, by slopes to
    the power ``exponent``; cells outside ``own`` only receive. No cell there: not a number in ``z``."""
    h, w = z.shape
    share = np.zeros((len(SHIFTS), h, w))
    inner = (slice(1, -1), slice(1, -1))
    for k, (a, b) in enumerate(SHIFTS):
        fall = (z[inner] - z[1 + a : h - 1 + a, 1 + b : w - 1 + b]) / (a * a + b * b) ** 0.5
        share[k][inner] = np.where(fall > 0, fall, 0) ** exponent
    total = share.sum(axis=0)
    share = np.divide(share, total, out=np.zeros_like(share), where=total > 0).reshape(len(SHIFTS), -1)
    steps = [a * w + b for a, b in SHIFTS]
    flat = np.where(own, z, np.nan).ravel()
    through = q.ravel().tolist()
    for i in np.argsort(-flat, kind="stable")[: int(own.sum())].tolist():
        if through[i] > 0:
            for k in np.flatnonzero(share[:, i]).tolist():
                through[i + steps[k]] += through[i] * share[k, i]
    return np.array(through).reshape(h, w)


def multiple_flow(grid: DataFrame, exponent: float = 1.3, tile: int = 64) -> DataFrame:
    """(r, c, flow) of a grid (r, c, z, value): each cell's own value and what reaches it when all
    lower neighbours share a cell's water by their slopes to the power ``exponent``.

    Cells make a graph without circles but with many ways, so pointers cannot double. What flows is
    linear, though: a tile passes on what it was given, cells by falling height, and tells its
    neighbours what has crossed to them; next, only what is new runs on. The sum of all is that of one sweep over
    the grid, but for rounding. Rounds are as many as tile borders lie on the longest way down.
    """
    at = lambda x, k=0: F.floor((F.col(x) + k) / tile).cast("long")
    near = F.array_distinct(F.array(*(F.struct(at("r", a).alias("tr"), at("c", b).alias("tc")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    land = written(grid.select("r", "c", F.col("z").cast("double").alias("z"), F.explode(near).alias("_t")).select("_t.tr", "_t.tc", "r", "c", "z"))
    news = written(grid.select(at("r").alias("tr"), at("c").alias("tc"), "r", "c", F.col("value").cast("double").alias("q")))
    kind = "r long, c long, q double, own boolean"

    def run(key: tuple, cells: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key
        size = (tile + 2, tile + 2)
        place = lambda d: ((d["r"] - tr * tile + 1).to_numpy(), (d["c"] - tc * tile + 1).to_numpy())
        i, j = place(cells)
        z, q = np.full(size, np.nan), np.zeros(size)
        z[i, j] = cells["z"]
        own = np.zeros(size, bool)
        own[1:-1, 1:-1] = ~np.isnan(z[1:-1, 1:-1])
        gi, gj = place(given)
        np.add.at(q, (gi, gj), given["q"].to_numpy())
        out = pushed(z, own, q, exponent)[i, j]
        some = out > 0
        return pd.DataFrame({"r": cells["r"][some], "c": cells["c"][some], "q": out[some], "own": own[i, j][some]})

    done = None
    while news.head(1):
        woken = news.select("tr", "tc").distinct()
        ran = written(land.join(woken, ["tr", "tc"], "left_semi").groupBy("tr", "tc").cogroup(news.groupBy("tr", "tc")).applyInPandas(run, kind))
        part = ran.filter("own").select("r", "c", "q")
        done = part if done is None else written(done.unionByName(part).groupBy("r", "c").agg(F.sum("q").alias("q")))
        news = written(ran.filter("NOT own").groupBy("r", "c").agg(F.sum("q").alias("q")).select(at("r").alias("tr"), at("c").alias("tc"), "r", "c", "q"))
    if done is None:
        return grid.select("r", "c", F.col("value").cast("double").alias("flow"))
    flow = done.withColumnsRenamed({"r": "_r", "c": "_c"})
    return grid.join(flow, (grid["r"] == flow["_r"]) & (grid["c"] == flow["_c"]), "left").select("r", "c", F.coalesce("q", F.lit(0.0)).alias("flow"))
