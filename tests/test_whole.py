"""Queries that return every row, beside brute force or the tables' own counts."""

import math
import os

import pytest

from quillgrid.functions import hydrology
from quillgrid.operators import spatial
from quillgrid.plans import catalogue, catalogue_fields, catalogue_more  # noqa: F401
from quillgrid.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_cell_is_routed(spark):
    receiver = {r.cell: r.receiver for r in fx.forest(spark, SF).collect()}
    want = {(cell, m): 0 for cell in receiver for m in range(12)}
    for source in receiver:
        cell = source
        while cell is not None:
            for m in range(12):
                want[cell, m] += source * (m + 1) % 10
            cell = receiver.get(cell)
    want = {k: v for k, v in want.items() if k[0] in receiver}
    assert {(r.cell, r.month): r.outflow for r in catalogue.QUERIES["route_monthly_all"](spark, SF).collect()} == want


def test_every_job_and_window_is_ranked(spark):
    jobs = {}
    for r in fx.requests(spark, SF).collect():
        p = r.event_id * 7 % 3000
        jobs.setdefault(r.session, []).append((p // 1000, p % 1000 - min(50, r.key), r.event_id))
    want = {(s, j[2], k) for s, x in jobs.items() for k, j in enumerate(sorted(x), 1)}
    rows = catalogue.QUERIES["job_rank_all"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.session, r.event_id, r.rank) for r in rows} == want
    top = {}
    for r in fx.grid(spark, SF).collect():
        top[r.r // 8, r.c // 8] = max(r.z, top.get((r.r // 8, r.c // 8), r.z))
    order = sorted((z < 3000, not (abs(i - 10) <= 3 and abs(j - 4) <= 3), (i - 10) ** 2 + (j - 4) ** 2, i, j) for (i, j), z in top.items())
    rows = catalogue.QUERIES["priority_near_camera_all"](spark, SF).collect()
    assert sorted((r.rank, r.wi, r.wj) for r in rows) == [(k, *x[3:]) for k, x in enumerate(order, 1)]


def test_channels_of_all_months(spark):
    rows = catalogue.QUERIES["channel_hydraulics_monthly"](spark, SF).collect()
    cells = {r.cell for r in catalogue.months(spark, SF).select("cell").collect()}
    assert len(rows) == 12 * len(cells) and {(r.cell, r.month) for r in rows} == {(c, m) for c in cells for m in range(12)}
    given = {r.cell: r for r in catalogue.months(spark, SF).collect()}
    for r in rows:
        q, slope = given[r.cell].q, given[r.cell].slope
        mean = sum(x * t for x, t in zip(q, hydrology.MONTH_SECONDS, strict=True)) / sum(hydrology.MONTH_SECONDS)
        f = q[r.month]
        want = (0, 0, 0)
        if f > 0:
            width = 7.2 * mean**0.5 * (f / mean) ** 0.26
            depth = (f * 0.035 / (width * slope**0.5)) ** 0.6 if slope >= 1e-5 else 0.27 * mean**0.39 * (f / mean) ** 0.4
            want = (width, depth, f / (width * depth))
        assert all(abs(x - y) < 1e-5 for x, y in zip(r[2:], want, strict=True))


def test_stores_settle(spark):
    def run(temp, rain, pet, years):
        snow = soil = gw = 0.0
        for _ in range(years):
            total = 0.0
            for t, p, e, d in zip(temp, rain, pet, hydrology.MONTH_DAYS, strict=True):
                fall = p if t <= 0 else 0.0
                melt = min(snow + fall, 3.0 * max(t, 0) * d)
                spill = max(snow + fall - melt - 1000, 0)
                snow += fall - melt - spill
                liquid = p - fall + melt + spill
                wet = soil * math.exp(max(e - liquid, 0) / -150) - min(e - liquid, 0)
                surplus = max(wet - 150, 0)
                soil = wet - surplus
                base = (gw + surplus * 0.3) * -math.expm1(-d / 90)
                gw += surplus * 0.3 - base
                total += surplus * 0.7 + base
        return snow, soil, gw, total

    cells = {r.cell: r for r in catalogue.climate(spark, SF).collect()}
    rows = catalogue.QUERIES["periodic_water_balance"](spark, SF).collect()
    assert len(rows) == len(cells) and all(r.change <= 0.01 for r in rows)
    for r in rows:
        c = cells[r.cell]
        want = run(c.temp, c.rain, c.pet, 400)
        assert all(abs(x - y) < 0.1 for x, y in zip((r.snow, r.soil, r.gw, r.runoff), want, strict=True)), (r, want)


def test_shore_distance_of_far_and_dry_cells(spark):
    cells = [(r, c) for r in range(30) for c in range(4) if (r, c) not in {(29, 3), (28, 3), (0, 2)}]
    for water in ({(0, 3), (29, 0)}, {(5, 1)}, set()):
        grid = spark.createDataFrame([(r, c, -1 if (r, c) in water else 1) for r, c in cells], "r long, c long, z long")
        want = {(r, c): min((abs(r - i) + abs(c - j) for i, j in water), default=None) for r, c in cells}
        assert {(x.r, x.c): x.steps for x in spatial.shore_distance(grid, grid["z"] < 0).collect()} == want
    assert catalogue.QUERIES["shore_distance_all"](spark, SF).count() == fx.grid(spark, SF).count()
