"""Point and grid joins: bilinear, nearest k by buckets, radius, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.session import apart, cut

#: The eight directions, clockwise from north.
DIRECTIONS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(cells: DataFrame, row: str, col: str, keep: list[str]) -> DataFrame:
    """Each cell offered to its eight neighbours: (row, col) of the receiver, ``dir`` as
    the receiver sees it, and the giver's columns. An explode of eight, no join."""
    offers = F.array(*(F.struct(F.lit(k).alias("dir"), (F.col(row) - dr).alias("r"), (F.col(col) - dc).alias("c")) for k, (dr, dc) in enumerate(DIRECTIONS)))
    return cells.select(*keep, F.explode(offers).alias("_o")).select(*keep, F.col("_o.dir").alias("dir"), F.col("_o.r").alias("_r"), F.col("_o.c").alias("_c"))


def bilinear(points: DataFrame, grid: DataFrame, quarter: int = 4) -> DataFrame:
    """Samples ``grid`` (r, c, z) at points (id, y4, x4) in quarter cells: four
    weighted equi-joins in one, by exploding the corners. Points at the rim, where
    a corner is missing, are dropped by the count."""
    y, x = F.expr(f"y4 div {quarter}"), F.expr(f"x4 div {quarter}")
    fy, fx = F.col("y4") % quarter, F.col("x4") % quarter
    corners = F.array(*(
        F.struct((y + a).alias("r"), (x + b).alias("c"), ((fy if a else quarter - fy) * (fx if b else quarter - fx)).alias("w")) for a in (0, 1) for b in (0, 1)
    ))
    asked = points.select("id", F.explode(corners).alias("k")).select("id", "k.r", "k.c", "k.w")
    return (
        asked.join(grid, ["r", "c"]).groupBy("id").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.count("*").alias("n"))
        .filter("n = 4").select("id", (F.col("s") / (quarter * quarter)).alias("value"))
    )


def nearest_k(queries: DataFrame, points: DataFrame, k: int, bucket: int) -> DataFrame:
    """The ``k`` nearest of ``points`` (pid, x, y) to each of ``queries`` (qid, qx, qy), exact,
    ties by id; all of them where there are fewer.

    Points meet queries in a query's own bucket and the eight around it, which hold all
    that is nearer than a bucket's side. A query is settled once its k-th distance is
    under that; the others look again in buckets twice as wide, until one is as wide as
    everything. So a query far from all points costs a few more rounds, not more buckets.
    Queries at one place are looked up once, of points at one place only the first ``k`` can
    count, and ``bucket`` is halved while buckets hold more than four times ``k`` points on average.
    """
    asks = queries.filter("qx IS NOT NULL AND qy IS NOT NULL")
    same = Window.partitionBy("x", "y").orderBy("pid")
    points = cut(points.select("pid", "x", "y").withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k).drop("_n"))
    spread = lambda df, x, y: df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(x).alias("n"))
    one, two = spread(points, "x", "y").first(), spread(asks, "qx", "qy").first()
    reach = lambda a, b: max((d[b] for d in (one, two) if d["n"]), default=0) - min((d[a] for d in (one, two) if d["n"]), default=0)
    widest = max(reach("x0", "x1"), reach("y0", "y1"))
    while bucket > 1 and one["n"] * bucket * bucket > 4 * k * max(one["x1"] - one["x0"], 1) * max(one["y1"] - one["y0"], 1):
        bucket = max(1, bucket // 2)
    at = lambda c: F.floor(F.col(c) / F.lit(bucket))
    left, done = cut(asks.select("qx", "qy").distinct()), []
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    while True:
        probes = left.select("qx", "qy", F.explode(around).alias("_d")).select("qx", "qy", (at("qx") + F.col("_d.dx")).alias("bx"), (at("qy") + F.col("_d.dy")).alias("by"))
        d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
        near = probes.join(apart(points.withColumns({"bx": at("x"), "by": at("y")})), ["bx", "by"]).select("qx", "qy", "pid", d2.alias("d2"))
        rank = F.row_number().over(Window.partitionBy("qx", "qy").orderBy("d2", "pid"))
        best = cut(near.withColumn("rank", rank).filter(F.col("rank") <= k))
        if bucket > widest:
            done.append(best)
            break
        settled = best.filter((F.col("rank") == k) & (F.col("d2") < bucket * bucket)).select("qx", "qy")
        done.append(best.join(apart(settled), ["qx", "qy"], "left_semi"))
        left = cut(left.join(apart(settled), ["qx", "qy"], "left_anti"))
        if not left.head(1):
            break
        bucket *= 2
    return asks.join(apart(reduce(DataFrame.unionByName, done)), ["qx", "qy"]).select("qid", "pid", "d2", "rank")


def meeting_boxes(boxes: DataFrame, asks: DataFrame, bucket: int, period: int | None = None) -> DataFrame:
    """(id, ask) of half-open boxes (x0, y0, x1, y1) that overlap; with ``period``, asks
    are also tried one world width to either side. Boxes meet in the buckets they lie
    over, so there is a key to join by; a pair that shares several buckets is counted
    in the one with the upper corner of its overlap, so none needs sorting out."""
    def laid(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))
        return df.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))

    if period is not None:
        asks = asks.withColumn("_s", F.explode(F.array(F.lit(-period), F.lit(0), F.lit(period))))
        asks = asks.withColumns({"x0": F.col("x0") + F.col("_s"), "x1": F.col("x1") + F.col("_s")}).drop("_s")
    a, b = laid(boxes).alias("a"), laid(asks.withColumnRenamed("id", "ask")).alias("b")
    left, top = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    overlap = (left < F.least("a.x1", "b.x1")) & (top < F.least("a.y1", "b.y1"))
    first = (F.floor(left / bucket) == F.col("bx")) & (F.floor(top / bucket) == F.col("by"))
    return a.join(b, ["bx", "by"]).filter(overlap & first).select("id", "ask")


def meeting_totals(boxes: DataFrame, asks: DataFrame, bucket: int, period: int | None = None) -> DataFrame:
    """(ask, boxes, ids) of asks that meet any box: how many and the sum of their ids. Equal boxes meet as
    one, with their count and sum, and equal asks too, so that copies of places make no pairs."""
    place = ["x0", "y0", "x1", "y1"]
    several = boxes.groupBy(*place).agg(F.struct(F.count("*").alias("n"), F.sum("id").alias("ids")).alias("id"))
    asked = asks.select(*place).distinct().select("*", F.struct(*place).alias("id"))
    met = meeting_boxes(several, asked, bucket, period).groupBy("ask").agg(F.sum("id.n").alias("boxes"), F.sum("id.ids").alias("ids"))
    return asks.select(F.col("id").alias("ask"), *place).join(apart(met.select("ask.*", "boxes", "ids")), place).select("ask", "boxes", "ids")


def within_radius(points: DataFrame, x: int, y: int, radius: int, limit: int) -> DataFrame:
    """The nearest ``limit`` points of one place within a radius (a top-k, never a full sort)."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.filter(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).orderBy("d2", "pid").limit(limit)


def shore_distance(grid: DataFrame, water: Column) -> DataFrame:
    """(r, c, steps) of every cell of ``grid``: steps along rows and columns to the
    nearest cell of ``water``, null if there is none. Two passes of windows without
    bounds over rows and columns. Corners that the grid lacks are filled in for the
    passes, so that a path over them counts too."""
    wet = grid.select("r", "c", F.when(water, F.lit(0)).alias("d"), F.lit(True).alias("_own"))
    full = grid.select("r").distinct().crossJoin(grid.select("c").distinct())
    g = full.join(wet, ["r", "c"], "left")
    for line, along in (("r", "c"), ("c", "r")):
        w = Window.partitionBy(line)
        before = F.min(F.col("d") - F.col(along)).over(w.orderBy(along).rowsBetween(Window.unboundedPreceding, 0)) + F.col(along)
        after = F.min(F.col("d") + F.col(along)).over(w.orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col(along)
        g = g.withColumn("d", F.least(before, after))
    return g.filter("_own").select("r", "c", F.col("d").cast("long").alias("steps"))
