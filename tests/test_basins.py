"""Depressions, ways out and children of cells beside plain versions, and their edge cases."""

import heapq
import random

from pyspark.sql import functions as F

from quillgrid.operators import basins, refine

GRID = "cell long, r long, c long, z long, outlet boolean"


def flooded(rows):
    """A priority flood: the plain version."""
    at = {(r, c): (cell, z, out) for cell, r, c, z, out in rows}
    best, heap = {}, [(z, r, c) for cell, r, c, z, out in rows if out]
    for z, r, c in heap:
        best[r, c] = z
    heapq.heapify(heap)
    while heap:
        level, r, c = heapq.heappop(heap)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                n = (r + dr, c + dc)
                if n in at and n not in best:
                    best[n] = max(level, at[n][1])
                    heapq.heappush(heap, (best[n], *n))
    return {at[k][0]: best.get(k) for k in at}


def test_fill_matches_flood(spark):
    draw = random.Random(5)
    # ties and flats abound; an island of the grid has no outlet at all
    rows = [(r * 100 + c, r, c, draw.randint(0, 12), draw.random() < 0.02) for r in range(20) for c in range(24)]
    rows += [(9000 + k, 50, k, k % 3, False) for k in range(5)]
    out = basins.filled(spark.createDataFrame(rows, GRID)).collect()
    assert {x["cell"]: x["filled"] for x in out} == flooded(rows)
    ground = {x[0]: x[3] for x in rows}
    assert all(x["filled"] is None or x["depth"] == x["filled"] - ground[x["cell"]] >= 0 for x in out)


def test_fill_of_nothing(spark):
    assert basins.filled(spark.createDataFrame([], GRID)).collect() == []


def test_children_keep_totals(spark):
    rows = [(k, k // 5, k % 5, (k * 37) % 11, 1000 + k) for k in range(23)]
    shares = refine.descend(spark.createDataFrame(rows, "cell long, r long, c long, weight long, total long"), 8)
    sums = {x["cell"]: (x["s"], x["n"]) for x in shares.groupBy("cell").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect()}
    assert sums == {x[0]: (x[4], 64) for x in rows}


def test_flat_field_stays_flat(spark):
    rows = [(k, k // 4, k % 4, 7) for k in range(12)]
    out = refine.envelope(spark.createDataFrame(rows, "cell long, r long, c long, z long"), 4, 0.5)
    assert {(x["low"], x["high"]) for x in out.collect()} == {(6.5, 7.5)}


def test_long_way_and_first_failure(spark):
    # 3,000 reaches in a row; the one at 1,000 is too shallow, those below it are open
    rows = [(k, k - 1 if k else None, 0, 2, 0, 1, 9, 1 if k == 1000 else 9, 1, False, k == 0) for k in range(3000)]
    reaches = spark.createDataFrame(rows, "cell long, receiver long, month int, length long, slope int, flow int, width int, depth int, velocity int, obstacle boolean, outlet boolean")
    boat = [{"vessel": "punt", "min_depth": 2, "min_width": 3, "max_slope": 4, "max_velocity": 5}]
    out = {x["cell"]: (x["open"], x["limit_reach"], x["reason"], x["route"]) for x in basins.navigable(reaches, boat).collect()}
    assert out == {k: (True, None, 0, 2 * (k + 1)) if k < 1000 else (False, 1000, basins.REASONS["depth"], 0) for k in range(3000)}


def test_first_owner(spark):
    rows = [(0, None, None), (1, 0, 8), (2, 1, None), (3, 2, 9), (4, 3, None), (5, 0, None)]
    out = basins.owners(spark.createDataFrame(rows, "cell long, receiver long, owner long")).collect()
    assert {x["cell"]: x["owner"] for x in out} == {0: None, 1: 8, 2: 8, 3: 9, 4: 9, 5: None}
