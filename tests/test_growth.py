"""What may not grow with the square of copies or through the driver, on tables small enough to look at."""

import time

from pyspark.sql import functions as F
from quillgrid.operators import basins, contours, graph, monthly, raster, routing, segments, spatial, tiles
from quillgrid.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().toString()


def test_exploded_months_are_not_sent_through_the_driver(spark):
    names = "cell long, receiver long, month long, length long, slope long, flow long, width long, depth long, velocity long, obstacle boolean, outlet boolean"
    reaches = spark.createDataFrame([(k, k // 2 if k > 1 else None, m, 1, 0, 1, 9, 9, 0, False, k == 1) for k in range(1, 9) for m in range(3)], names)
    boat = [{"vessel": "punt", "min_depth": 2, "min_width": 3, "max_slope": 14, "max_velocity": 18}]
    out = basins.navigable(reaches, boat)
    assert "Broadcast" not in plan(out)
    assert {(r.month, r.cell): (r.open, r.route) for r in out.collect()} == {(m, k): (True, k.bit_length()) for k in range(1, 9) for m in range(3)}


def test_a_reach_that_is_missing_in_a_month_ends_ways_without_result(spark):
    names = "cell long, receiver long, month long, length long, slope long, flow long, width long, depth long, velocity long, obstacle boolean, outlet boolean"
    rows = [(3, 2, m, 1, 0, 1, 9, 9, 0, False, False) for m in (0, 1)] + [(2, 1, 0, 1, 0, 1, 9, 9, 0, False, False)] + [(1, None, m, 1, 0, 1, 9, 9, 0, False, True) for m in (0, 1)] + [(7, 70, 0, 1, 0, 0, 9, 9, 0, False, False), (8, 80, 0, 1, 0, 1, 9, 9, 0, False, False)]
    boat = [{"vessel": "punt", "min_depth": 2, "min_width": 3, "max_slope": 14, "max_velocity": 18}]
    got = {(r.month, r.cell): (r.open, r.limit_reach, r.reason, r.route) for r in basins.navigable(spark.createDataFrame(rows, names), boat).collect()}
    assert got == {(0, 3): (True, None, 0, 3), (0, 2): (True, None, 0, 2), (0, 1): (True, None, 0, 1), (1, 1): (True, None, 0, 1), (0, 7): (False, 7, 1, 0)}


def test_monthly_routing_joins_cells_not_months(spark, monkeypatch):
    seen = []
    real = graph.accumulate_all
    monkeypatch.setattr(graph, "accumulate_all", lambda nodes, *a: (seen.append(nodes.count()), real(nodes, *a))[1])
    out = catalogue.QUERIES["route_monthly_all"](spark, "/root/testdata/sf0.001")
    cells = out.select("cell").distinct().count()
    assert seen == [cells] and out.count() == 12 * cells


def test_losses_of_months_are_not_joined_back(spark):
    rows = [(k, k // 2 if k > 1 else None, m, k + m, 2) for k in range(1, 9) for m in range(3) if (k, m) != (5, 1)]
    out = routing.route_with_loss(spark.createDataFrame(rows, "cell long, receiver long, month long, lateral long, loss long"))
    assert "Broadcast" not in plan(out)
    got = {(r.cell, r.month): (r.inflow, r.loss, r.outflow) for r in out.collect()}
    assert len(got) == len(rows) and got[8, 0] == (0, 2, 6) and got[4, 0] == (6, 2, 8) and (5, 1) not in got


def test_segments_are_laid_out_once_however_far_points_are(spark, monkeypatch):
    seen = []
    real = segments.covered
    monkeypatch.setattr(segments, "covered", lambda *a: (seen.append(a[1]), real(*a))[1])
    lines = spark.createDataFrame([(k, k, 0, k + 3, 2) for k in range(50)], "id long, x0 long, y0 long, x1 long, y1 long")
    points = spark.createDataFrame([(k, 50_000 + k % 3, -70_000) for k in range(90)], "id long, px long, py long")
    got = segments.nearest(points, lines, 16.0).collect()
    assert len(seen) == 1 and len(got) == 90 and {r.segment for r in got} == {49}


def test_crossings_are_told_once_without_sorting_out(spark):
    lines = spark.createDataFrame([(k, 3 * k, -40, 3 * k + 1, 40) for k in range(9)] + [(10 + k, -5, 7 * k, 90, 7 * k) for k in range(4)], "id long, x0 long, y0 long, x1 long, y1 long")
    out = segments.crossings(lines, 4)
    assert "Aggregate" not in plan(out)
    got = [(r.a, r.b) for r in out.collect()]
    assert sorted(got) == [(a, 10 + b) for a in range(9) for b in range(4)]


def test_copies_of_places_make_no_pairs(spark):
    n = 20_000
    begun = time.time()
    asks = spark.range(n).select(F.col("id").alias("qid"), F.lit(5).cast("long").alias("qx"), F.lit(5).cast("long").alias("qy"))
    points = spark.range(n).select(F.col("id").alias("pid"), F.lit(6).cast("long").alias("x"), F.lit(5).cast("long").alias("y"))
    got = spatial.nearest_k(asks, points, 4, 32)
    assert got.count() == 4 * n and got.filter("pid < 4 AND d2 = 1 AND rank = pid + 1").count() == 4 * n
    boxes = spark.range(n).select("id", *(F.lit(v).cast("long").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 9), ("y1", 9))))
    met = spatial.meeting_totals(boxes, boxes.withColumn("x0", F.lit(8).cast("long")), 4)
    assert met.filter(f"boxes = {n} AND ids = {n * (n - 1) // 2}").count() == n
    assert time.time() - begun < 100


def test_smoothing_shuffles_cells_not_weights(spark):
    """Tiles smaller than the reach and the grid give what one tile gives, and no offer of a single weight is shuffled."""
    grid = spark.range(600).select(F.expr("id div 20").alias("r"), (F.col("id") % 20).alias("c"), (F.col("id") * 37 % 101).alias("z")).filter("id % 7 != 3")
    one, many = (raster.gaussian(grid, {"a": 1.2, "b": 3.0}, 30, 20, modes=("reflect", "wrap"), tile=t) for t in (256, 8))
    assert "Aggregate" not in plan(many)
    got = {(r.r, r.c): (r.a, r.b) for r in many.collect()}
    assert len(got) == grid.count()
    assert all(abs(got[r.r, r.c][0] - r.a) < 1e-9 and abs(got[r.r, r.c][1] - r.b) < 1e-9 for r in one.collect())


def test_periodic_years_are_settled_by_batches(spark):
    df = spark.createDataFrame([(0, [-5.0] * 12, [10.0] * 12, [5.0] * 12), (1, [5.0] * 12, [10.0] * 12, [5.0] * 12), (2, None, [1.0] * 12, [1.0] * 12), (3, [5.0] * 11 + [None], [1.0] * 12, [1.0] * 12)], "k int, t array<double>, p array<double>, e array<double>")
    out = df.select("k", monthly.periodic_year(F.col("t"), F.col("p"), F.col("e")).alias("s"))
    assert "ArrowEvalPython" in plan(out)
    got = {r.k: r.s for r in out.collect()}
    # the pack is at its cap and sheds all that falls
    assert got[0].snow == 1000 and abs(got[0].aet + got[0].runoff - 120) < 1e-6 and abs(got[1].soil - 150) < 1e-6 and abs(got[1].runoff - 60) < 1e-6
    assert all(v is None for k in (2, 3) for v in got[k])


def test_tiles_find_what_neighbours_tell(spark):
    """Receivers and lowest passes by small tiles, with gaps and cells without height, beside plain loops; no offers are joined."""
    grid = spark.range(300).select(F.col("id").alias("cell"), F.expr("id div 20 - 3").alias("r"), (F.col("id") % 20).alias("c"), F.when(F.col("id") % 13 != 4, F.col("id") * 37 % 23).alias("z")).filter("cell % 11 != 5")
    out = tiles.steepest(grid, 4)
    assert "Join" not in plan(out) and "Join" not in plan(graph.steepest_receivers(grid))
    rows = grid.collect()
    at = {(x.r, x.c): x for x in rows if x.z is not None}
    near = lambda x: [(k, at[x.r + a, x.c + b]) for k, (a, b) in enumerate(spatial.DIRECTIONS) if (x.r + a, x.c + b) in at]
    steep = {x.cell: max((((x.z - y.z) ** 2 * (2 - k % 2), -k, y.cell) for k, y in near(x) if y.z < x.z), default=(0, 0, None))[2] if x.z is not None else None for x in rows}
    assert {x.cell: x.receiver for x in out.collect()} == steep
    labels = grid.select("*", (F.col("cell") % 3).alias("label"), (F.col("cell") % 17 == 0).alias("low"))
    met = tiles.lowest_passes(labels, 4).groupBy("a", "b").agg(F.min(F.struct("w", "at", "dir")).alias("k"))
    want = {}
    for x in at.values():
        for k, y in near(x):
            if x.cell % 17 and x.cell % 3 != y.cell % 3 and (y.cell % 17 == 0 or (y.z, y.cell) < (x.z, x.cell)):
                pair = (x.cell % 3, y.cell % 3)
                want[pair] = min(want.get(pair, (99,)), (x.z, x.cell, k))
    assert {(r.a, r.b): tuple(r.k) for r in met.collect()} == want


def test_points_of_contours_are_written_once(spark, monkeypatch):
    """Doubling is for pieces that leave a tile; points within it are followed there."""
    rows = []
    real = contours.written
    monkeypatch.setattr(contours, "written", lambda df: (lambda out: (rows.append(out.count()), out)[1])(real(df)))
    grid = spark.range(64 * 400).select(F.expr("id div 64").alias("r"), (F.col("id") % 64).alias("c"), (F.col("id") * 7919 % 101).alias("z"))
    n = contours.rings(grid, 80.5).count()
    assert n > 5_000 and sum(rows) < 1.2 * n
