"""Queries over depressions, the water that fills them, and ways across them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import basins, depressions, drainage, graph
from quillgrid.operators.statistics import running_totals
from quillgrid.plans import fixtures as fx
from quillgrid.plans.catalogue import query
from quillgrid.plans.catalogue_relief import FILL_SQL

#: Runoff, loss and area of the cells of the grid, in whole units.
RUNOFF, LOSS, AREA = "1 + cell % 7", "cell * 7 % 5 * 6", "1 + cell % 3"


def watered(spark, sf_dir):
    """The grid with outlets below sea level, runoff, loss and area, and the pit below each cell."""
    g = fx.grid(spark, sf_dir).withColumns({"outlet": F.col("z") < 0, "runoff": F.expr(RUNOFF), "loss": F.expr(LOSS), "area": F.expr(AREA)})
    return depressions.written(depressions.pits(g))


def filled_and_spilled(spark, sf_dir):
    at = watered(spark, sf_dir)
    nodes = depressions.tree(at)
    cells = depressions.attached(at, nodes)
    sums = depressions.budget(at, nodes, cells)
    return at, nodes, cells, sums, depressions.cascade(nodes, sums)


@query("depression_tree")
def depression_tree(spark, sf_dir):
    """Every depression: its parent, where it spills, and the leaves on both sides of its pass."""
    return depressions.tree(watered(spark, sf_dir))


@query(
    "depression_roots",
    f"""{FILL_SQL}, low AS (SELECT g.cell, bool_and(n.z >= g.z) AS pit FROM g JOIN dirs ON true JOIN g n ON n.r = g.r + dr AND n.c = g.c + dc WHERE g.z >= 0 GROUP BY 1)
    SELECT low.cell AS pit, f.level AS spill FROM low JOIN f USING (cell) WHERE pit""",
)
def depression_roots(spark, sf_dir):
    """For each pit the height at which its outermost depression spills, which is where water on it reaches the sea."""
    nodes = depression_tree(spark, sf_dir)
    ends = graph.roots(nodes.select(F.col("node").alias("cell"), F.col("parent").alias("receiver")))
    spill = nodes.select(F.col("node").alias("root"), "spill")
    return ends.filter(f"cell > {depressions.OUTLET}").join(spill, "root").select(F.col("cell").alias("pit"), "spill")


@query("depression_budget")
def depression_budget(spark, sf_dir):
    """Runoff into each depression; its loss, area and volume when it stands at its spill."""
    at = watered(spark, sf_dir)
    nodes = depressions.tree(at)
    return depressions.budget(at, nodes, depressions.attached(at, nodes))


@query("fill_spill")
def fill_spill(spark, sf_dir):
    """Every depression in the long run: what reaches it, whether it is full, and what it passes on."""
    return filled_and_spilled(spark, sf_dir)[4]


@query("final_lakes")
def final_lakes(spark, sf_dir):
    """The lakes that the cascade leaves, told apart by depression."""
    at, nodes, cells, _, flow = filled_and_spilled(spark, sf_dir)
    return depressions.lakes(at, nodes, cells, flow)[0]


@query(
    "fill_spill_balance",
    f"SELECT sum(CASE WHEN o_totalprice IS NULL OR CAST(floor(o_totalprice) AS BIGINT) % 5000 < 1000 THEN 0 ELSE {RUNOFF.replace('cell', 'o_orderkey')} END)::BIGINT AS runoff, 0::BIGINT AS unaccounted FROM orders",
)
def fill_spill_balance(spark, sf_dir):
    """All runoff on land beside what of it is neither lost from lakes nor passed to the sea: mass closes."""
    at, nodes, cells, _, flow = filled_and_spilled(spark, sf_dir)
    out, _ = depressions.lakes(at, nodes, cells, flow)
    kept = out.agg(F.coalesce(F.sum(F.col("water") - F.col("passed")), F.lit(0)).alias("kept"))
    # what reaches outlets: straight, or from a chain of whole trees of which the last spills there
    tops = nodes.filter("parent IS NULL").select("node", "beyond").join(flow, "node")
    direct = at.filter((F.col("leaf") == depressions.OUTLET) & ~F.col("outlet")).agg(F.coalesce(F.sum("runoff"), F.lit(0)).alias("direct"))
    over = tops.filter(F.col("beyond") == depressions.OUTLET).agg(F.coalesce(F.sum("passed"), F.lit(0)).alias("over"))
    total = at.filter("NOT outlet").agg(F.sum("runoff").alias("runoff"))
    one = lambda df: df.select("*", F.lit(1).alias("_1"))
    sums = one(total).join(one(kept), "_1").join(one(direct), "_1").join(one(over), "_1")
    return sums.select("runoff", (F.col("runoff") - F.col("kept") - F.col("direct") - F.col("over")).alias("unaccounted"))


# ---- ways across what is filled ----------------------------------------------------------

#: Receivers on the filled surface, as CTEs that end in rcv (cell, receiver).
COMPLETE_SQL = f"""{FILL_SQL},
    s AS MATERIALIZED (SELECT g.cell, g.r, g.c, g.z < 0 AS outlet, CASE WHEN g.z < 0 THEN g.z ELSE f.level END AS z FROM g JOIN f USING (cell)),
    n AS MATERIALIZED (SELECT s.cell, s.z, s.outlet, o.cell AS o, o.z AS oz, o.outlet AS o_out, k FROM s JOIN dirs ON true JOIN s o ON o.r = s.r + dr AND o.c = s.c + dc),
    fall AS (SELECT cell, arg_max(o, (z - oz) * (z - oz) * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END * 8 - k) AS receiver FROM n WHERE oz < z AND NOT outlet GROUP BY 1),
    flat AS MATERIALIZED (SELECT cell, z FROM s WHERE NOT outlet AND cell NOT IN (SELECT cell FROM fall)),
    fe AS MATERIALIZED (SELECT n.* FROM n JOIN flat USING (cell)),
    pairs AS MATERIALIZED (SELECT e.cell AS a, e.o AS b FROM fe e JOIN flat x ON x.cell = e.o WHERE e.z = e.oz),
    t(cell, d) USING KEY (cell) AS (
      SELECT DISTINCT e.cell, 1 FROM fe e WHERE e.oz = e.z AND e.o NOT IN (SELECT cell FROM flat)
      UNION SELECT p.b, min(t.d + 1) FROM t JOIN pairs p ON p.a = t.cell LEFT JOIN recurring.t AS old ON old.cell = p.b WHERE old.d IS NULL OR t.d + 1 < old.d GROUP BY p.b),
    w(cell, d) USING KEY (cell) AS (
      SELECT DISTINCT e.cell, 1 FROM fe e WHERE e.oz > e.z
      UNION SELECT p.b, min(w.d + 1) FROM w JOIN pairs p ON p.a = w.cell LEFT JOIN recurring.w AS old ON old.cell = p.b WHERE old.d IS NULL OR w.d + 1 < old.d GROUP BY p.b),
    m AS MATERIALIZED (SELECT t.cell, 2 * t.d - coalesce(w.d, 0) AS mask FROM t LEFT JOIN w USING (cell)),
    over AS (SELECT e.cell, arg_min(e.o, (CASE WHEN x.cell IS NULL THEN 0 ELSE 1 END, coalesce(om.mask, 0), k % 2, k)) AS receiver FROM fe e JOIN m USING (cell) LEFT JOIN flat x ON x.cell = e.o LEFT JOIN m om ON om.cell = e.o
      WHERE e.oz = e.z AND (x.cell IS NULL OR om.mask < m.mask) GROUP BY 1),
    rcv AS MATERIALIZED (SELECT s.cell, coalesce(fall.receiver, over.receiver) AS receiver FROM s LEFT JOIN fall USING (cell) LEFT JOIN over USING (cell))"""


def filled_surface(spark, sf_dir):
    g = fx.grid(spark, sf_dir).withColumn("outlet", F.col("z") < 0)
    level = basins.filled(g).select("cell", "filled")
    return g.join(level, "cell").select("cell", "r", "c", F.when(F.col("outlet"), F.col("z")).otherwise(F.col("filled")).alias("z"), "outlet")


@query("drainage_complete", f"{COMPLETE_SQL} SELECT cell, receiver FROM rcv")
def drainage_complete(spark, sf_dir):
    """A receiver for every cell that is no outlet: down the filled surface, across lakes and flats."""
    return drainage.receivers(filled_surface(spark, sf_dir))


@query(
    "drainage_order",
    f"""{COMPLETE_SQL}, up(cell, spot, steps) AS (SELECT cell, receiver, 0 FROM rcv UNION ALL SELECT up.cell, rcv.receiver, steps + 1 FROM up JOIN rcv ON rcv.cell = up.spot),
    l AS (SELECT cell, max(steps) AS steps FROM up GROUP BY 1)
    SELECT cell, steps::BIGINT AS steps, row_number() OVER (ORDER BY steps, cell) - 1 AS place FROM l""",
)
def drainage_order(spark, sf_dir):
    """Cells in an order in which receivers stand before their donors: by steps to the outlet, then by cell."""
    steps = graph.roots(drainage_complete(spark, sf_dir)).select(F.lit(0).alias("all"), "cell", "steps", F.lit(1).cast("long").alias("one"))
    return running_totals(steps, "all", [F.col("steps"), F.col("cell")], "one").select("cell", "steps", F.col("_before").alias("place"))


EXPONENT = 1.3


@query(
    "multiple_flow",
    f"""WITH RECURSIVE {fx.GRID_SQL}, {fx.DIRECTIONS_SQL},
    n AS (SELECT g.cell, o.cell AS o, pow((g.z - o.z) / CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END, {EXPONENT!r}::DOUBLE) AS s FROM g JOIN dirs ON true JOIN g o ON o.r = g.r + dr AND o.c = g.c + dc WHERE o.z < g.z),
    w AS MATERIALIZED (SELECT cell, o, s / sum(s) OVER (PARTITION BY cell) AS w FROM n),
    x(cell, k, q) AS (SELECT cell, 0, (1 + cell % 10)::DOUBLE FROM g UNION ALL SELECT w.o, x.k + 1, sum(x.q * w.w) FROM x JOIN w ON w.cell = x.cell GROUP BY 1, 2)
    SELECT g.r, g.c, round(sum(q), 6) AS flow FROM x JOIN g USING (cell) GROUP BY 1, 2""",
)
def multiple_flow(spark, sf_dir):
    """Each cell's own water and what reaches it when all lower neighbours share a cell's flow."""
    g = fx.grid(spark, sf_dir).select("r", "c", "z", (1 + F.col("cell") % 10).alias("value"))
    return drainage.multiple_flow(g, EXPONENT).select("r", "c", F.round("flow", 6).alias("flow"))


@query(
    "cheapest_ways",
    f"""WITH RECURSIVE {fx.GRID_SQL}, {fx.DIRECTIONS_SQL}, p AS MATERIALIZED (SELECT cell, r, c, 1 + (z + 1000) // 250 AS cost FROM g WHERE z < 2500),
    e AS MATERIALIZED (SELECT p.cell AS b, o.cell AS a, k, (p.cost + o.cost) * CASE WHEN k % 2 = 0 THEN {drainage.STRAIGHT} ELSE {drainage.SLANTING} END AS w FROM p JOIN dirs ON true JOIN p o ON o.r = p.r + dr AND o.c = p.c + dc),
    d(cell, far) USING KEY (cell) AS (
      SELECT cell, 0::BIGINT FROM p WHERE cell % 997 = 3
      UNION SELECT e.b, min(d.far + e.w) FROM d JOIN e ON e.a = d.cell LEFT JOIN recurring.d AS old ON old.cell = e.b WHERE old.far IS NULL OR d.far + e.w < old.far GROUP BY e.b),
    x AS (SELECT e.b AS cell, arg_min(e.a, k) AS previous FROM e JOIN d n ON n.cell = e.b JOIN d o ON o.cell = e.a WHERE o.far + e.w = n.far GROUP BY 1)
    SELECT p.cell, d.far AS distance, x.previous FROM p LEFT JOIN d USING (cell) LEFT JOIN x USING (cell)""",
)
def cheapest_ways(spark, sf_dir):
    """The cheapest way to every cell of a corridor below 2,500 m from a few starts, and the cell before it."""
    g = fx.grid(spark, sf_dir).filter("z < 2500")
    return drainage.cheapest(g.select("cell", "r", "c", F.expr("1 + (z + 1000) div 250").alias("cost"), (F.col("cell") % 997 == 3).alias("start")))
