"""Queries over noise, children of cells, depressions and ways to an outlet."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import functions as F

from quillgrid.functions import geography, keys, lattice, noise
from quillgrid.operators import basins, graph, refine
from quillgrid.operators.spatial import neighbours
from quillgrid.plans import fixtures as fx
from quillgrid.plans.catalogue import query
from quillgrid.plans.catalogue_fields import _mix_sql, rounded
from quillgrid.session import written
from quillgrid.sources.tables import table

# ---- noise ---------------------------------------------------------------------------

LOD, WEST, WIDTH = 10, -20e6, 40e6
SIZE = lattice.NATIVE_M * 2**LOD
PERIOD = round(WIDTH / SIZE)
PROVINCE = ("resources", "noise", "province", f"lod{LOD}")


@query(
    "keyed_noise",
    f"""WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919 % 40000) * 1000 - 20000000)::DOUBLE AS x, ((o_custkey * 104729 % 20000) * 1000 - 10000000)::DOUBLE AS y FROM orders),
    q AS (SELECT id, (x - {WEST!r}::DOUBLE) / {WIDTH!r}::DOUBLE * {PERIOD} - {PERIOD // 2} - 0.5::DOUBLE AS gx, y / {SIZE!r}::DOUBLE - 0.5::DOUBLE AS gy FROM p),
    c AS (SELECT id, a, b, gx - floor(gx) AS fx, gy - floor(gy) AS fy, (((floor(gx)::BIGINT + a + {PERIOD // 2}) % {PERIOD}) + {PERIOD}) % {PERIOD} - {PERIOD // 2} AS i, floor(gy)::BIGINT + b AS j
          FROM q, unnest([0, 1]) s(a), unnest([0, 1]) t(b)),
    s AS (SELECT *, ({LOD + 16}::HUGEINT * 576460752303423488 + (i + 536870912)::HUGEINT * 536870912 + (j + 268435456)) AS node FROM c),
    {fx.draw_sql("s", "node", keys.key(7, PROVINCE))},
    e AS (SELECT id, fx * fx * (3 - 2 * fx) AS ux, fy * fy * (3 - 2 * fy) AS uy, a, b, 2 * ((k >> 11)::DOUBLE / 9007199254740992.0) - 1 AS v FROM d3)
    SELECT id, round(sum(CASE WHEN a = 1 THEN ux ELSE 1 - ux END * CASE WHEN b = 1 THEN uy ELSE 1 - uy END * v), 6) AS value FROM e GROUP BY id""",
)
def keyed_noise(spark, sf_dir):
    """Keyed value noise at places on a world that wraps."""
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 40000 * 1000 - 20_000_000).cast("double").alias("x"), (F.col("o_custkey") * 104729 % 20000 * 1000 - 10_000_000).cast("double").alias("y")
    )
    return p.select("id", *rounded({"value": noise.value_noise(7, "province", LOD, F.col("x"), F.col("y"), WEST, WIDTH)}))


SEED, LAYER, HIGH, DECAY, SHARE = 77, 3, 5, 0.8, 0.3
RELIEF, MOVES = range(2, HIGH + 1), range(2, 5)
WEIGHTS = {o: 2.0 ** (DECAY * (o - HIGH)) for o in RELIEF}
SPREAD = sqrt(sum(w * w for w in WEIGHTS.values())) * noise.SPREAD


def _octaves_sql(source: str, parts: dict) -> str:
    """Each sample's octaves from columns id, i, j, wx, wy (metres): columns part, o, v."""
    salts = ", ".join(f"({part}, {o}, {noise.salt(SEED, LAYER, o, part)}::BIGINT)" for part, levels in parts.items() for o in levels)
    return f"""k(part, o, salt) AS (VALUES {salts}),
    m AS (SELECT id, part, o, salt, ((i & ((1 << o) - 1)) + 0.5::DOUBLE) / (1 << o) + wx / (30 * (1 << o))::DOUBLE AS fx, ((j & ((1 << o) - 1)) + 0.5::DOUBLE) / (1 << o) + wy / (30 * (1 << o))::DOUBLE AS fy, i >> o AS ci, j >> o AS cj FROM {source}, k),
    c AS (SELECT id, part, o, salt, a, b, fx - floor(fx) AS tx, fy - floor(fy) AS ty, (ci + floor(fx)::BIGINT + a)::HUGEINT & 4294967295::HUGEINT AS ni, (cj + floor(fy)::BIGINT + b)::HUGEINT & 4294967295::HUGEINT AS nj FROM m, unnest([0, 1]) s(a), unnest([0, 1]) t(b)),
    h AS (SELECT *, {_mix_sql(f"(nj + {geography.SPREAD_J}) % 4294967296::HUGEINT")} AS hj FROM c),
    x AS (SELECT *, xor(xor(((ni * {geography.SPREAD_I}) % 4294967296::HUGEINT)::BIGINT, hj), salt) AS y FROM h),
    u AS (SELECT *, ({_mix_sql("y")} >> 8) / 8388608.0::DOUBLE - 1 AS n, tx * tx * tx * (tx * (tx * 6 - 15) + 10) AS qx, ty * ty * ty * (ty * (ty * 6 - 15) + 10) AS qy FROM x),
    v AS (SELECT id, part, o, sum(CASE WHEN a = 1 THEN qx ELSE 1 - qx END * CASE WHEN b = 1 THEN qy ELSE 1 - qy END * n) AS v FROM u GROUP BY id, part, o)"""


SAMPLES_SQL = "SELECT o_orderkey AS id, o_custkey * 31 % 4096 AS i, o_orderkey * 17 % 4096 AS j, 0.0::DOUBLE AS wx, 0.0::DOUBLE AS wy FROM orders"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 31 % 4096).alias("i"), (F.col("o_orderkey") * 17 % 4096).alias("j"))


@query(
    "domain_warp",
    f"""WITH s AS ({SAMPLES_SQL}), {_octaves_sql("s", {1: MOVES, 2: MOVES})}
    SELECT id, round(sum(v * (0.3::DOUBLE * 30 * (1 << o))) FILTER (part = 1), 6) AS wx, round(sum(v * (0.3::DOUBLE * 30 * (1 << o))) FILTER (part = 2), 6) AS wy FROM v GROUP BY id""",
)
def domain_warp(spark, sf_dir):
    wx, wy = (noise.summed(noise.octaves(SEED, LAYER, MOVES, noise.by_wavelength(SHARE), part), F.col("i"), F.col("j"), 0) for part in (1, 2))
    return _samples(spark, sf_dir).select("id", *rounded({"wx": wx, "wy": wy}))


@query(
    "fractal_noise",
    f"""WITH s AS (SELECT id, i, j, (i % 64 - 32) * 2.5::DOUBLE AS wx, (j % 64 - 32) * 1.5::DOUBLE AS wy FROM ({SAMPLES_SQL})), {_octaves_sql("s", {0: WEIGHTS})}
    SELECT id, round(sum(v * pow(2.0::DOUBLE, {DECAY!r}::DOUBLE * (o - {HIGH}))) / {SPREAD!r}::DOUBLE, 6) AS value FROM v GROUP BY id""",
)
def fractal_noise(spark, sf_dir):
    """A weighted sum of octaves at samples that are moved."""
    s = _samples(spark, sf_dir).withColumns({"wx": (F.col("i") % 64 - 32) * 2.5, "wy": (F.col("j") % 64 - 32) * 1.5})
    terms = noise.octaves(SEED, LAYER, RELIEF, noise.by_decay(DECAY, RELIEF))
    return s.select("id", *rounded({"value": noise.summed(terms, F.col("i"), F.col("j"), 0, (F.col("wx"), F.col("wy")))}))


# ---- children of cells -----------------------------------------------------------------


def _children_sql(n: int, source: str, name: str) -> str:
    """4 n^2 times the bilinear value of column ``name`` of ``source`` at a child (a, b)."""
    s, e = "abs(fr)", "abs(fc)"
    other = lambda t: f"coalesce({t}.{name}, g.{name})"
    return f"""(SELECT g.cell, a, b, ({2 * n} - {s}) * ({2 * n} - {e}) * g.{name} + {s} * ({2 * n} - {e}) * {other("v")} + ({2 * n} - {s}) * {e} * {other("h")} + {s} * {e} * {other("d")} AS {name}
      FROM (SELECT *, k // {n} AS a, k % {n} AS b, 2 * (k // {n}) + 1 - {n} AS fr, 2 * (k % {n}) + 1 - {n} AS fc FROM {source}, range({n * n}) t(k)) g
      LEFT JOIN {source} v ON v.r = g.r + sign(fr) AND v.c = g.c LEFT JOIN {source} h ON h.r = g.r AND h.c = g.c + sign(fc) LEFT JOIN {source} d ON d.r = g.r + sign(fr) AND d.c = g.c + sign(fc))"""


@query(
    "budget_descent",
    f"""WITH {fx.GRID_SQL}, p AS (SELECT cell, r, c, z + 1000 AS weight FROM g), f AS {_children_sql(4, "p", "weight")},
    t AS (SELECT *, 1000003 + cell AS total, CASE WHEN sum(weight) OVER (PARTITION BY cell) = 0 THEN 1 ELSE weight END AS w FROM f),
    s AS (SELECT *, total * w // sum(w) OVER q AS s, total * w % sum(w) OVER q AS rest FROM t WINDOW q AS (PARTITION BY cell)),
    k AS (SELECT *, total - sum(s) OVER (PARTITION BY cell) AS left_, row_number() OVER (PARTITION BY cell ORDER BY rest DESC, a * 4 + b) AS rank FROM s)
    SELECT cell, a, b, (s + CASE WHEN rank <= left_ AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS share FROM k""",
)
def budget_descent(spark, sf_dir):
    """Every cell's total over its children two levels down."""
    g = fx.grid(spark, sf_dir).select("cell", "r", "c", (F.col("z") + 1000).alias("weight"), (F.col("cell") + 1000003).alias("total"))
    return refine.descend(g, 4)


@query(
    "parent_envelope",
    f"""WITH {fx.GRID_SQL}, p AS (SELECT g.cell, g.r, g.c, min(n.z) AS low, max(n.z) AS high FROM g JOIN g n ON n.r BETWEEN g.r - 1 AND g.r + 1 AND n.c BETWEEN g.c - 1 AND g.c + 1 GROUP BY 1, 2, 3),
    l AS {_children_sql(2, "p", "low")}, h AS {_children_sql(2, "p", "high")}
    SELECT cell, a, b, low / 16.0::DOUBLE - 5 AS low, high / 16.0::DOUBLE + 5 AS high FROM l JOIN h USING (cell, a, b)""",
)
def parent_envelope(spark, sf_dir):
    """Bounds of children from their parents' surroundings."""
    return refine.envelope(fx.grid(spark, sf_dir), 2, 5.0)


# ---- depressions and ways out ------------------------------------------------------------

FILL_SQL = f"""WITH RECURSIVE {fx.GRID_SQL}, {fx.DIRECTIONS_SQL},
    e AS MATERIALIZED (SELECT g.cell AS a, n.cell AS b, n.z AS z FROM g JOIN dirs ON true JOIN g n ON n.r = g.r + dr AND n.c = g.c + dc WHERE n.z >= 0),
    f(cell, level) USING KEY (cell) AS (
      SELECT cell, z FROM g WHERE z < 0
      UNION
      SELECT e.b, min(greatest(f.level, e.z)) FROM f JOIN e ON e.a = f.cell LEFT JOIN recurring.f AS old ON old.cell = e.b
      WHERE old.level IS NULL OR greatest(f.level, e.z) < old.level GROUP BY e.b)"""


@query("depression_fill", f"{FILL_SQL} SELECT g.cell, f.level AS filled, f.level - g.z AS depth FROM g LEFT JOIN f USING (cell)")
def depression_fill(spark, sf_dir):
    """The level at which water on a cell first reaches the sea."""
    return basins.filled(fx.grid(spark, sf_dir).withColumn("outlet", F.col("z") < 0))


@query(
    "lake_levels",
    f"""{FILL_SQL}, wet AS MATERIALIZED (SELECT g.cell, g.r, g.c, g.z, f.level FROM g JOIN f USING (cell) WHERE f.level > g.z),
    m AS MATERIALIZED (SELECT a.cell AS a, b.cell AS b FROM wet a JOIN dirs ON true JOIN wet b ON b.r = a.r + dr AND b.c = a.c + dc),
    l(cell, lake) USING KEY (cell) AS (
      SELECT cell, cell FROM wet
      UNION
      SELECT m.b, min(l.lake) FROM l JOIN m ON m.a = l.cell JOIN recurring.l AS old ON old.cell = m.b WHERE l.lake < old.lake GROUP BY m.b)
    SELECT lake, max(level) AS level, count(*) AS cells, sum(level - z)::BIGINT AS volume, max(level - z) AS deepest FROM l JOIN wet USING (cell) GROUP BY 1""",
)
def lake_levels(spark, sf_dir):
    """Cells, level, volume and greatest depth of each connected water above ground, by its least cell."""
    g = fx.grid(spark, sf_dir)
    wet = written(g.join(basins.filled(g.withColumn("outlet", F.col("z") < 0)), "cell").filter("depth > 0"))
    near = neighbours(wet, "r", "c", ["cell"]).withColumnRenamed("cell", "a")
    edges = wet.join(near, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c"))).select("a", F.col("cell").alias("b")).filter("a < b")
    lakes = graph.components(edges, wet.select(F.col("cell").alias("node")))
    return wet.join(lakes, F.col("cell") == F.col("node")).groupBy(F.col("label").alias("lake")).agg(
        F.max("filled").alias("level"), F.count("*").alias("cells"), F.sum("depth").alias("volume"), F.max("depth").alias("deepest")
    )


@query(
    "owner_downstream",
    f"""WITH RECURSIVE {fx.DRAINAGE_SQL}, o AS (SELECT cell, receiver, CASE WHEN cell % 5 = 0 THEN cell % 97 END AS owner FROM drain),
    w(cell, receiver, owner) AS (SELECT cell, receiver, owner FROM o UNION ALL SELECT w.cell, o.receiver, o.owner FROM w JOIN o ON o.cell = w.receiver WHERE w.owner IS NULL)
    SELECT cell, max(owner) AS owner FROM w GROUP BY 1""",
)
def owner_downstream(spark, sf_dir):
    """The first owner each cell drains into."""
    return basins.owners(graph.steepest_receivers(fx.grid(spark, sf_dir)).withColumn("owner", F.when(F.col("cell") % 5 == 0, F.col("cell") % 97)))


VESSELS = [
    {"vessel": "punt", "min_depth": 2, "min_width": 3, "max_slope": 14, "max_velocity": 18},
    {"vessel": "barge", "min_depth": 5, "min_width": 8, "max_slope": 12, "max_velocity": 16},
]
REACH = {
    "length": "1 + cell % 13", "slope": "cell % 16", "flow": "(cell + month) % 40", "width": "1 + (cell * 7 + month) % 60", "depth": "1 + (cell * 3 + month) % 50",
    "velocity": "(cell * 11 + month) % 20", "obstacle": "cell % 41 = 0", "outlet": "cell % 29 = 1",
}


@query(
    "navigability",
    f"""WITH RECURSIVE {fx.FOREST_SQL}, v(vessel, min_depth, min_width, max_slope, max_velocity) AS (VALUES {', '.join(str(tuple(x.values())) for x in VESSELS)}),
    x AS (SELECT cell, receiver, month, {', '.join(f"{e} AS {k}" for k, e in REACH.items())} FROM f, range(12) t(month)),
    l AS (SELECT vessel, month, cell, receiver, length, outlet, CASE WHEN flow <= 0 THEN 1 WHEN obstacle THEN 6 WHEN slope > max_slope THEN 5 WHEN depth < min_depth THEN 2 WHEN width < min_width THEN 3 WHEN velocity > max_velocity THEN 4 ELSE 0 END AS why FROM x, v),
    w(vessel, month, cell, spot, receiver, way, outlet, why) AS (
      SELECT vessel, month, cell, cell, receiver, length, outlet, why FROM l
      UNION ALL SELECT w.vessel, w.month, w.cell, l.cell, l.receiver, w.way + l.length, l.outlet, l.why FROM w JOIN l ON l.vessel = w.vessel AND l.month = w.month AND l.cell = w.receiver WHERE w.why = 0 AND NOT w.outlet)
    SELECT vessel, month, cell, why = 0 AND outlet AS open, CASE WHEN NOT (why = 0 AND outlet) THEN spot END AS limit_reach, CASE WHEN why > 0 THEN why WHEN outlet THEN 0 ELSE 7 END AS reason, CASE WHEN why = 0 AND outlet THEN way ELSE 0 END AS route
    FROM w WHERE why > 0 OR outlet OR receiver IS NULL""",
)
def navigability(spark, sf_dir):
    """Which reaches each class of vessel can leave for an outlet, month by month."""
    f = fx.forest(spark, sf_dir).select("cell", "receiver", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("month"))
    return basins.navigable(f.withColumns({k: F.expr(e) for k, e in REACH.items()}), VESSELS)
