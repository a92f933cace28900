"""The named queries of the engine and, beside each, the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions import hydrology, keys, lattice
from quillgrid.operators import apportion as ap
from quillgrid.operators import graph, monthly, routing, spatial
from quillgrid.operators import statistics as st
from quillgrid.plans import fixtures as fx
from quillgrid.sources.tables import table
from quillgrid.streaming import serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its SQL where SQL can express it."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query(
    "region_budget_summary",
    """
    WITH cells AS (
      SELECT r.r_name AS region, l_partkey % 128 AS i, l_suppkey % 128 AS j,
             CAST(round_even(l_quantity * 1000, 0) AS BIGINT) AS quanta
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation n ON s_nationkey = n_nationkey
      JOIN region r ON n.n_regionkey = r_regionkey)
    SELECT region, CAST(sum(quanta) AS BIGINT) AS budget, count(*) AS cell_rows,
           count(DISTINCT i * 128 + j) AS cells
    FROM cells GROUP BY region""",
)
def region_budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed integer quanta by region; dimension sides are joined by size."""
    line = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 128 * 128 + F.col("l_suppkey") % 128).alias("cell"),
        "l_suppkey",
        F.rint(F.col("l_quantity") * 1000).cast("long").alias("quanta"),
    )
    geo = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("region"))
    )
    return (
        line.join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("region", "cell").agg(F.sum("quanta").alias("b"), F.count("*").alias("n"))
        .groupBy("region")
        .agg(F.sum("b").alias("budget"), F.sum("n").alias("cell_rows"), F.count("*").alias("cells"))
    )


# ---- addresses and keys ----------------------------------------------------

LATTICE_SQL = "l AS (SELECT l_partkey % 128 - 64 AS i, l_suppkey % 128 - 64 AS j, CAST(round_even(l_quantity * 1000, 0) AS BIGINT) AS quanta FROM lineitem)"


def lattice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 128 - 64).alias("i"), (F.col("l_suppkey") % 128 - 64).alias("j"), F.rint(F.col("l_quantity") * 1000).cast("long").alias("quanta")
    )


@query(
    "cell_id_roundtrip",
    f"""WITH {LATTICE_SQL}, u AS (SELECT DISTINCT i, j, (18::HUGEINT * 576460752303423488 + (i + 536870912)::HUGEINT * 536870912 + (j + 268435456))::HUGEINT AS h FROM l)
    SELECT i, j, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS cell, 2::BIGINT AS lod2, i AS i2, j AS j2 FROM u""",
)
def cell_id_roundtrip(spark, sf_dir):
    df = lattice_cells(spark, sf_dir).select("i", "j").distinct().withColumn("cell", lattice.cell_id(F.lit(2), F.col("i"), F.col("j")))
    lod, i, j = lattice.decode_id(F.col("cell"))
    return df.select("i", "j", "cell", lod.cast("long").alias("lod2"), i.alias("i2"), j.alias("j2"))


@query("quadtree_parent_sum", f"WITH {LATTICE_SQL} SELECT i >> 3 AS pi, j >> 3 AS pj, sum(quanta)::BIGINT AS quanta, count(*) AS n FROM l GROUP BY 1, 2")
def quadtree_parent_sum(spark, sf_dir):
    return lattice_cells(spark, sf_dir).groupBy(lattice.parent(F.col("i"), 3).alias("pi"), lattice.parent(F.col("j"), 3).alias("pj")).agg(
        F.sum("quanta").alias("quanta"), F.count("*").alias("n")
    )


DRAW = ("resources", "demo")


@query(
    "splitmix_draw",
    f"""WITH {fx.draw_sql("orders", "o_orderkey", keys.key(42, DRAW))}
    SELECT CAST(floor((k >> 11)::DOUBLE / 9007199254740992.0 * 16) AS BIGINT) AS bucket, count(*) AS n, min(o_orderkey) AS first FROM d3 GROUP BY 1""",
)
def splitmix_draw(spark, sf_dir):
    u = keys.to_unit(keys.cell_key(42, DRAW, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy(F.floor(u * 16).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query(
    "poisson_counts",
    f"""WITH {fx.draw_sql("orders", "o_orderkey", keys.key(42, DRAW))},
    cum AS (SELECT lam, n, sum(exp(-lam) * pow(lam, n) / gamma(n + 1.0)) OVER (PARTITION BY lam ORDER BY n) AS c
            FROM (SELECT unnest([1, 2, 3, 4, 5])::DOUBLE AS lam), unnest(range(0, 41)) u(n)),
    k AS (SELECT 1 + o_orderkey % 5 AS lam, (SELECT count(*) FROM cum WHERE cum.lam = 1 + o_orderkey % 5 AND c <= (k >> 11)::DOUBLE / 9007199254740992.0) AS k FROM d3)
    SELECT lam, k, count(*) AS n FROM k GROUP BY 1, 2""",
)
def poisson_counts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((1 + F.col("o_orderkey") % 5).alias("lam"), keys.to_unit(keys.cell_key(42, DRAW, F.col("o_orderkey"))).alias("u"))
    return df.groupBy("lam", keys.poisson(F.col("u"), F.col("lam").cast("double")).alias("k")).agg(F.count("*").alias("n"))


# ---- exact budgets -----------------------------------------------------------


@query(
    "apportion_children",
    """WITH a AS (SELECT o_custkey % 50 AS parent, o_orderkey AS child, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS weight, 1000003 + (o_custkey % 50) * 7 AS total FROM orders),
    b AS (SELECT *, (total * weight) // sum(weight) OVER p AS s, (total * weight) % sum(weight) OVER p AS rest FROM a WINDOW p AS (PARTITION BY parent)),
    c AS (SELECT *, total - sum(s) OVER (PARTITION BY parent) AS left_, row_number() OVER (PARTITION BY parent ORDER BY rest DESC, child) AS rank FROM b)
    SELECT parent, child, (s + CASE WHEN rank <= left_ AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS share FROM c""",
)
def apportion_children(spark, sf_dir):
    parent = F.col("o_custkey") % 50
    df = table(spark, sf_dir, "orders").select(
        parent.alias("parent"), F.col("o_orderkey").alias("child"), (F.floor("o_totalprice").cast("long") % 1000).alias("weight"), (1000003 + parent * 7).alias("total")
    )
    return ap.apportion(df, "parent", "child", "weight", "total").select("parent", "child", "share")


CLEAR = ("resources", "history", "clearing")


@query(
    "clearing_prefix",
    f"""WITH {fx.draw_sql("orders", "o_orderkey", keys.key(7, CLEAR))},
    a AS (SELECT o_custkey % 20 AS parent, o_orderkey AS child, 1 + o_orderkey % 5 AS area,
            (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100.0::DOUBLE * (0.9::DOUBLE + 0.2::DOUBLE * ((k >> 11)::DOUBLE / 9007199254740992.0)) AS score FROM d3),
    b AS (SELECT *, coalesce(sum(area) OVER (PARTITION BY parent ORDER BY score DESC, child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
    SELECT parent, child, round(greatest(0.0, least(1.0, (700.5 - before) / area::DOUBLE)), 6)::DOUBLE AS fraction FROM b""",
)
def clearing_prefix(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("parent"), F.col("o_orderkey").alias("child"), (1 + F.col("o_orderkey") % 5).alias("area"), "o_totalprice")
    jitter = keys.to_unit(keys.cell_key(7, CLEAR, F.col("child")))
    score = (F.floor("o_totalprice").cast("long") % 100) / F.lit(100.0) * (F.lit(0.9) + F.lit(0.2) * jitter)
    out = ap.clearing_prefix(df, "parent", "child", "area", score, F.lit(700.5))
    return out.select("parent", "child", F.round("fraction", 6).alias("fraction"))


@query("deposit_stock_by_cell", """SELECT p_partkey % 4096 AS owner, p_type AS metal, sum(p_size)::BIGINT AS ore,
    CAST(round_even(sum(CAST(round_even(p_retailprice * 100, 0) AS BIGINT)), 0) AS BIGINT) AS grade_cents FROM part GROUP BY 1, 2""")
def deposit_stock_by_cell(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 4096).alias("owner"), F.col("p_type").alias("metal")).agg(
        F.sum("p_size").alias("ore"), F.sum(F.rint(F.col("p_retailprice") * 100).cast("long")).alias("grade_cents")
    )


# ---- statistics ----------------------------------------------------------------

PROBABILITIES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    "weighted_quantiles",
    """WITH v AS (SELECT o_orderpriority AS grp, o_orderkey AS tie, floor(o_totalprice)::DOUBLE AS v, (1 + o_orderkey % 3)::DOUBLE AS w FROM orders),
    a AS (SELECT *, (sum(w) OVER (PARTITION BY grp ORDER BY v, tie ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY grp) AS p FROM v),
    b AS (SELECT *, lead(p) OVER o AS pn, lead(v) OVER o AS vn, row_number() OVER o = 1 AS first FROM a WINDOW o AS (PARTITION BY grp ORDER BY v, tie))
    SELECT grp, q AS p, round(CASE WHEN (first AND q < p) OR pn IS NULL THEN v ELSE v + (vn - v) * (q - p) / (pn - p) END, 6) AS quantile
    FROM b, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS u(q) WHERE (p <= q AND (pn IS NULL OR q < pn)) OR (first AND q < p)""",
)
def weighted_quantiles(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("tie"), F.floor("o_totalprice").alias("v"), (1 + F.col("o_orderkey") % 3).alias("w"))
    return st.weighted_quantiles(df, "grp", "v", "w", "tie", PROBABILITIES).select("grp", "p", F.round("quantile", 6).alias("quantile"))


EDGES = [-1000, -750, -500, -250, 0, 250, 500, 1000, 1500, 2000, 2500, 3000, 3500]


@query("hypsometry_histogram", f"WITH {fx.GRID_SQL} SELECT len(list_filter({EDGES}, lambda e: e <= z))::BIGINT AS bin, sum(1 + r % 4)::BIGINT AS weight FROM g GROUP BY 1")
def hypsometry_histogram(spark, sf_dir):
    return st.histogram(fx.grid(spark, sf_dir).withColumn("w", 1 + F.col("r") % 4), "z", "w", EDGES)


@query(
    "top_share_10_20",
    """WITH a AS (SELECT p_brand AS grp, p_partkey AS id, p_size AS score, 1 + p_partkey % 3 AS area, p_size * (1 + p_partkey % 3) AS mass FROM part),
    b AS (SELECT *, coalesce(sum(area) OVER (PARTITION BY grp ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(area) OVER (PARTITION BY grp) AS ta, sum(mass) OVER (PARTITION BY grp) AS tm FROM a)
    SELECT grp, f AS fraction, round(sum(greatest(0.0, least(1.0, (f * ta::DOUBLE - before::DOUBLE) / area::DOUBLE)) * mass::DOUBLE) / max(tm)::DOUBLE, 6) AS share
    FROM b, unnest([0.1, 0.2]::DOUBLE[]) u(f) GROUP BY 1, 2""",
)
def top_share_10_20(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_size").alias("score"), (1 + F.col("p_partkey") % 3).alias("area"))
    out = st.top_share(df.withColumn("mass", F.col("score") * F.col("area")), "grp", "score", "area", "mass", [0.1, 0.2], "id")
    return out.select("grp", "fraction", F.round("share", 6).alias("share"))


@query("block_mean_complete", f"WITH {fx.GRID_SQL} SELECT r // 4 AS block_row, c // 4 AS block_col, sum(z)::DOUBLE / 16 AS mean FROM g GROUP BY 1, 2 HAVING count(*) = 16")
def block_mean_complete(spark, sf_dir):
    return st.block_mean(fx.grid(spark, sf_dir), "r", "c", "z", 4)


@query(
    "window_fusion",
    f"""WITH {fx.GRID_SQL}, w AS (SELECT r, c, z + (r // 32 - a + c // 32 - b) % 2 AS v,
      least(r - (r // 32 - a) * 32 + 1, 64 - (r - (r // 32 - a) * 32)) * least(c - (c // 32 - b) * 32 + 1, 64 - (c - (c // 32 - b) * 32)) AS w
      FROM g, unnest([0, 1]) x(a), unnest([0, 1]) y(b) WHERE r // 32 - a >= 0 AND c // 32 - b >= 0)
    SELECT r, c, round(sum(w * v)::DOUBLE / sum(w)::DOUBLE, 6) AS fused FROM w GROUP BY 1, 2""",
)
def window_fusion(spark, sf_dir):
    """Windows that each see the height plus their own parity, fused again."""
    seen = F.col("z") + (F.col("_wi") + F.col("_wj")) % 2
    return st.window_fusion(fx.grid(spark, sf_dir), "r", "c", "z", 64, 32, seen).select("r", "c", F.round("fused", 6).alias("fused"))


# ---- joins ------------------------------------------------------------------


@query(
    "missing_contributors",
    f"""WITH {fx.GRID_SQL}, need AS (SELECT br * 16 + x AS r, y AS c FROM (SELECT DISTINCT r // 16 AS br FROM g), unnest(range(16)) a(x), unnest(range(64)) b(y))
    SELECT r // 16 AS block, count(*) AS missing FROM need ANTI JOIN g USING (r, c) GROUP BY 1""",
)
def missing_contributors(spark, sf_dir):
    g = fx.grid(spark, sf_dir).select("r", "c")
    need = g.select(F.expr("r div 16").alias("br")).distinct().select(F.explode(F.expr("sequence(br * 16, br * 16 + 15)")).alias("r")).withColumn("c", F.explode(F.expr("sequence(0L, 63L)")))
    return need.join(g, ["r", "c"], "left_anti").groupBy(F.expr("r div 16").alias("block")).agg(F.count("*").alias("missing"))


@query(
    "bilinear_sample",
    f"""WITH {fx.GRID_SQL}, p AS (SELECT c_custkey AS id, c_custkey * 7 % 300 AS y4, c_custkey * 13 % 250 AS x4 FROM customer),
    k AS (SELECT id, y4 // 4 + a AS r, x4 // 4 + b AS c, (CASE WHEN a = 1 THEN y4 % 4 ELSE 4 - y4 % 4 END) * (CASE WHEN b = 1 THEN x4 % 4 ELSE 4 - x4 % 4 END) AS w FROM p, unnest([0, 1]) s(a), unnest([0, 1]) t(b))
    SELECT id, sum(w * z)::DOUBLE / 16 AS value FROM k JOIN g USING (r, c) GROUP BY id HAVING count(*) = 4""",
)
def bilinear_sample(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 300).alias("y4"), (F.col("c_custkey") * 13 % 250).alias("x4"))
    return spatial.bilinear(p, fx.grid(spark, sf_dir).select("r", "c", "z"))


POINTS_SQL = "pts AS (SELECT p_partkey AS pid, p_partkey * 7919 % 1000 AS x, p_partkey * 104729 % 997 AS y FROM part)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), (F.col("p_partkey") * 7919 % 1000).alias("x"), (F.col("p_partkey") * 104729 % 997).alias("y"))


@query("radius_top12", f"WITH {POINTS_SQL} SELECT pid, x, y, (x - 500) * (x - 500) + (y - 500) * (y - 500) AS d2 FROM pts WHERE d2 <= 10000 ORDER BY d2, pid LIMIT 12")
def radius_top12(spark, sf_dir):
    return spatial.within_radius(points(spark, sf_dir), 500, 500, 100, 12)


@query(
    "knn4_bucketed",
    f"""WITH {POINTS_SQL}, s AS (SELECT s_suppkey AS qid, s_suppkey * 331 % 1000 AS qx, s_suppkey * 577 % 997 AS qy FROM supplier),
    a AS (SELECT qid, pid, (x - qx) * (x - qx) + (y - qy) * (y - qy) AS d2 FROM s, pts)
    SELECT qid, pid, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, pid)::INTEGER AS rank FROM a QUALIFY rank <= 4""",
)
def knn4_bucketed(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") * 331 % 1000).alias("qx"), (F.col("s_suppkey") * 577 % 997).alias("qy"))
    return spatial.nearest_k(q, points(spark, sf_dir), 4, 32)


@query("portal_edges", f"WITH {fx.FOREST_SQL} SELECT cell, receiver, CASE WHEN cell % 7 < 3 THEN -1 ELSE 1 END AS direction FROM f WHERE receiver IS NOT NULL AND (cell % 7 < 3) <> (receiver % 7 < 3)")
def portal_edges(spark, sf_dir):
    """Receiver edges with one end inside the region: 1 goes in, -1 goes out."""
    inside = lambda c: F.col(c) % 7 < 3
    return fx.forest(spark, sf_dir).filter(F.col("receiver").isNotNull() & (inside("cell") != inside("receiver"))).select("cell", "receiver", F.when(inside("cell"), -1).otherwise(1).alias("direction"))


@query(
    "interval_overlap_peak",
    """WITH e AS (SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, 1 AS d FROM lineitem
      UNION ALL SELECT l_returnflag, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER), -1 FROM lineitem),
    s AS (SELECT flag, day, sum(d) AS d FROM e GROUP BY 1, 2), o AS (SELECT flag, day, sum(d) OVER (PARTITION BY flag ORDER BY day) AS open FROM s)
    SELECT flag, max(open)::BIGINT AS peak, count(*) AS days FROM o GROUP BY 1""",
)
def interval_overlap_peak(spark, sf_dir):
    """Sweep of starts and ends, summed by day before the window sees them."""
    day = F.to_date("l_shipdate")
    ends = F.array(F.struct(day.alias("day"), F.lit(1).alias("d")), F.struct(F.date_add(day, F.col("l_quantity").cast("int")).alias("day"), F.lit(-1).alias("d")))
    deltas = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.explode(ends).alias("e")).groupBy("flag", "e.day").agg(F.sum("e.d").alias("d"))
    return deltas.withColumn("open", F.sum("d").over(Window.partitionBy("flag").orderBy("day"))).groupBy("flag").agg(F.max("open").alias("peak"), F.count("*").alias("days"))


@query(
    "tile_seam_step",
    f"""WITH {fx.GRID_SQL} SELECT a.c // 8 AS tx, sum(abs(b.z - a.z))::BIGINT AS seam, sum(abs(a.z - i.z))::BIGINT AS inner_step, count(*) AS n
    FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g i ON i.r = a.r AND i.c = a.c - 1 WHERE a.c % 8 = 7 GROUP BY 1""",
)
def tile_seam_step(spark, sf_dir):
    """Steps over tile seams beside the last steps inside; by one window over rows."""
    w = Window.partitionBy("r").orderBy("c")
    g = fx.grid(spark, sf_dir).withColumns({"nz": F.lead("z").over(w), "nc": F.lead("c").over(w), "pz": F.lag("z").over(w), "pc": F.lag("c").over(w)})
    g = g.filter((F.col("c") % 8 == 7) & (F.col("nc") == F.col("c") + 1) & (F.col("pc") == F.col("c") - 1))
    return g.groupBy(F.expr("c div 8").alias("tx")).agg(F.sum(F.abs(F.col("nz") - F.col("z"))).alias("seam"), F.sum(F.abs(F.col("z") - F.col("pz"))).alias("inner_step"), F.count("*").alias("n"))


# ---- graphs -----------------------------------------------------------------


@query("d8_receivers", f"WITH {fx.DRAINAGE_SQL} SELECT cell, receiver FROM drain")
def d8_receivers(spark, sf_dir):
    return graph.steepest_receivers(fx.grid(spark, sf_dir))


@query(
    "flow_accumulation",
    f"""WITH RECURSIVE {fx.DRAINAGE_SQL}, up AS (SELECT cell AS source, cell FROM drain UNION ALL SELECT up.source, drain.receiver FROM up JOIN drain ON up.cell = drain.cell WHERE drain.receiver IS NOT NULL)
    SELECT up.cell, sum(1 + up.source % 10)::BIGINT AS total FROM up GROUP BY 1""",
)
def flow_accumulation(spark, sf_dir):
    d = graph.steepest_receivers(fx.grid(spark, sf_dir))
    return graph.accumulate(d.withColumn("value", 1 + F.col("cell") % 10))


@query(
    "basin_roots",
    f"""WITH RECURSIVE {fx.DRAINAGE_SQL}, up AS (SELECT cell AS source, cell, 0 AS steps FROM drain UNION ALL SELECT up.source, drain.receiver, steps + 1 FROM up JOIN drain ON up.cell = drain.cell WHERE drain.receiver IS NOT NULL)
    SELECT source AS cell, arg_max(cell, steps) AS root, max(steps)::BIGINT AS steps FROM up GROUP BY 1""",
)
def basin_roots(spark, sf_dir):
    return graph.roots(graph.steepest_receivers(fx.grid(spark, sf_dir)))


@query(
    "strahler_order",
    f"""WITH RECURSIVE {fx.FOREST_SQL},
    lv AS (SELECT cell, cell AS at, 0 AS depth FROM f UNION ALL SELECT lv.cell, f.receiver, depth + 1 FROM lv JOIN f ON f.cell = lv.at WHERE f.receiver IS NOT NULL),
    dp AS (SELECT cell, max(depth) AS depth FROM lv GROUP BY 1), """
    + ", ".join(
        f"s{k} AS (SELECT f.cell, f.receiver, coalesce((SELECT max(o) + CASE WHEN count(*) FILTER (o = mx) > 1 THEN 1 ELSE 0 END FROM (SELECT o, max(o) OVER () AS mx FROM "
        + (f"s{k + 1}" if k < 15 else "(SELECT 0::BIGINT AS cell, 0::BIGINT AS receiver, 0::BIGINT AS o WHERE false)")
        + f" t WHERE t.receiver = f.cell)), 1)::BIGINT AS o FROM f JOIN dp USING (cell) WHERE depth = {k})"
        for k in range(15, -1, -1)
    )
    + " SELECT cell, o AS \"order\" FROM (" + " UNION ALL ".join(f"FROM s{k}" for k in range(16)) + ")",
)
def strahler_order(spark, sf_dir):
    return routing.strahler(fx.forest(spark, sf_dir).select("cell", F.when(F.col("cell") > 0, F.col("receiver")).alias("receiver")))


@query(
    "upstream_watershed",
    f"WITH RECURSIVE {fx.FOREST_SQL}, up AS (SELECT cell, 0 AS steps FROM f WHERE cell = 5 UNION ALL SELECT f.cell, steps + 1 FROM up JOIN f ON f.receiver = up.cell) SELECT cell, steps::BIGINT AS steps FROM up",
)
def upstream_watershed(spark, sf_dir):
    """Cells draining through cell 5, with their distance: ancestors by doubling, then a filter."""
    f = fx.forest(spark, sf_dir)
    cut_at = f.select("cell", F.when(F.col("cell") != 5, F.col("receiver")).alias("receiver"))
    return graph.roots(cut_at).filter("root = 5").select("cell", "steps")


@query(
    "downstream_path",
    f"WITH RECURSIVE {fx.FOREST_SQL}, p AS (SELECT max(cell) AS cell, 0 AS step FROM f UNION ALL SELECT f.receiver, step + 1 FROM p JOIN f ON f.cell = p.cell WHERE f.receiver IS NOT NULL) SELECT cell, step::BIGINT AS step FROM p",
)
def downstream_path(spark, sf_dir):
    """The cells that the last cell drains through, by doubling."""
    f = fx.forest(spark, sf_dir)
    return graph.downstream(f, f.agg(F.max("cell").alias("cell"))).select("cell", "step")


@query(
    "connected_components",
    f"""WITH RECURSIVE {fx.GRID_SQL}, {fx.DIRECTIONS_SQL}, m AS (SELECT * FROM g WHERE z < 0),
    e AS (SELECT a.cell AS a, b.cell AS b FROM m a JOIN dirs ON true JOIN m b ON b.r = a.r + dr AND b.c = a.c + dc),
    reach AS (SELECT cell AS a, cell AS b FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
    SELECT a AS node, min(b) AS label FROM reach GROUP BY 1""",
)
def connected_components(spark, sf_dir):
    low = fx.grid(spark, sf_dir).filter("z < 0")
    offers = spatial.neighbours(low, "r", "c", ["cell"]).withColumnRenamed("cell", "b")
    edges = low.join(offers, (low["r"] == offers["_r"]) & (low["c"] == offers["_c"])).select(F.col("cell").alias("a"), "b")
    return graph.components(edges, low.select(F.col("cell").alias("node")))


@query(
    "coast_specks",
    ORACLES["connected_components"].replace("SELECT a AS node, min(b) AS label FROM reach GROUP BY 1", "")
    + "SELECT label, count(*) AS n FROM (SELECT a AS node, min(b) AS label FROM reach GROUP BY 1) GROUP BY 1 HAVING count(*) <= 4",
)
def coast_specks(spark, sf_dir):
    """Components of four cells at most."""
    return connected_components(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).filter("n <= 4")


@query(
    "reach_extraction",
    f"""WITH RECURSIVE {fx.DRAINAGE_SQL}, n AS (SELECT receiver AS cell, count(*) AS donors FROM drain WHERE receiver IS NOT NULL GROUP BY 1),
    x AS (SELECT drain.cell, receiver, coalesce(donors, 0) AS donors FROM drain LEFT JOIN n USING (cell)),
    w AS (SELECT cell AS head, cell FROM x WHERE donors <> 1 UNION ALL SELECT w.head, x2.cell FROM w JOIN x ON x.cell = w.cell JOIN x x2 ON x2.cell = x.receiver WHERE x2.donors = 1)
    SELECT head, count(*) AS cells FROM w GROUP BY 1""",
)
def reach_extraction(spark, sf_dir):
    """Reaches begin where a cell has not exactly one donor and run on while it has;
    each cell finds its head by doubling over its only donor."""
    d = graph.cut(graph.steepest_receivers(fx.grid(spark, sf_dir)))
    only = d.filter("receiver IS NOT NULL").groupBy(F.col("receiver").alias("cell")).agg(F.count("*").alias("n"), F.min("cell").alias("donor")).filter("n = 1")
    up = d.select("cell").join(only.select("cell", F.col("donor").alias("receiver")), "cell", "left")
    return graph.roots(up).groupBy(F.col("root").alias("head")).agg(F.count("*").alias("cells"))


@query(
    "dilate_k2",
    f"""WITH {fx.GRID_SQL} SELECT DISTINCT b.r, b.c FROM g a JOIN unnest([-2, -1, 0, 1, 2]) x(dr) ON true JOIN unnest([-2, -1, 0, 1, 2]) y(dc) ON true
    JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z > 3900""",
)
def dilate_k2(spark, sf_dir):
    g = fx.grid(spark, sf_dir)
    return graph.dilate(g.filter("z > 3900"), g, 2)


@query(
    "route_monthly_all",
    f"""WITH RECURSIVE {fx.FOREST_SQL}, up AS (SELECT cell AS source, cell FROM f UNION ALL SELECT up.source, f.receiver FROM up JOIN f ON up.cell = f.cell WHERE f.receiver IS NOT NULL)
    SELECT cell, m AS month, sum((source * (m + 1)) % 10)::BIGINT AS outflow FROM up, unnest(range(12)) t(m) GROUP BY 1, 2""",
)
def route_monthly_all(spark, sf_dir):
    """Monthly totals routed downstream without loss, of every cell: one accumulation
    of the twelve months side by side."""
    f = fx.forest(spark, sf_dir).select("cell", "receiver", *((F.col("cell") * (m + 1) % 10).alias(f"m{m}") for m in range(12)))
    each = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("month"), F.col(f"m{m}").alias("outflow")) for m in range(12)))).alias("_m")
    return graph.accumulate_all(f, [f"m{m}" for m in range(12)]).select("cell", each).select("cell", "_m.*")


# ---- rasters ----------------------------------------------------------------


@query("contour_bands", f"WITH {fx.GRID_SQL} SELECT CAST(floor(z / 250.0) AS BIGINT) AS band, count(*) AS cells, min(z) AS low, max(z) AS high FROM g GROUP BY 1")
def contour_bands(spark, sf_dir):
    return fx.grid(spark, sf_dir).groupBy(F.floor(F.col("z") / 250.0).cast("long").alias("band")).agg(F.count("*").alias("cells"), F.min("z").alias("low"), F.max("z").alias("high"))


@query("land_mask_blocks", f"WITH {fx.GRID_SQL} SELECT r // 4 AS br, c // 4 AS bc, bool_or(z >= 0) AS any_land, bool_or(z < 0) AS any_water FROM g GROUP BY 1, 2")
def land_mask_blocks(spark, sf_dir):
    return fx.grid(spark, sf_dir).groupBy(F.expr("r div 4").alias("br"), F.expr("c div 4").alias("bc")).agg(F.bool_or(F.col("z") >= 0).alias("any_land"), F.bool_or(F.col("z") < 0).alias("any_water"))


@query(
    "shore_distance_all",
    f"""WITH {fx.GRID_SQL}, w AS (SELECT r, c FROM g WHERE z < 0)
    SELECT g.r, g.c, min(abs(g.r - w.r) + abs(g.c - w.c))::BIGINT AS steps FROM g LEFT JOIN w ON true GROUP BY 1, 2""",
)
def shore_distance_all(spark, sf_dir):
    """Steps along rows and columns to the nearest water, of every cell; null without
    any water."""
    return spatial.shore_distance(fx.grid(spark, sf_dir), F.col("z") < 0)


# ---- climate and months -----------------------------------------------------------


@query(
    "koppen_class",
    """WITH a AS (SELECT c_custkey AS cell, (c_custkey * 37 % 700) / 10.0::DOUBLE - 30 AS ts, (c_custkey * 53 % 700) / 10.0::DOUBLE - 40 AS tw, (c_custkey * 29 % 1500)::DOUBLE AS ps, (c_custkey * 31 % 1300)::DOUBLE AS pw FROM customer),
    b AS (SELECT *, greatest(ts, tw) AS hot, least(ts, tw) AS cold, (ts + tw) / 2 AS annual, CASE WHEN ts >= tw THEN ps ELSE pw END AS s, CASE WHEN ts >= tw THEN pw ELSE ps END AS w FROM a),
    c AS (SELECT *, s + w AS total, greatest(0.0, 20 * annual + CASE WHEN s + w = 0 OR s >= 0.7 * (s + w) AND s + w > 0 AND true THEN CASE WHEN s + w = 0 THEN 140 ELSE 280 END WHEN s <= 0.3 * (s + w) THEN 0 ELSE 140 END) AS threshold FROM b)
    SELECT cell, CASE WHEN hot < 0 THEN 'EF' WHEN hot < 10 THEN 'ET'
      WHEN total < threshold THEN CASE WHEN total < threshold * 0.5 THEN 'BW' ELSE 'BS' END || CASE WHEN annual < 18 THEN 'k' ELSE 'h' END
      WHEN cold >= 18 THEN CASE WHEN least(s, w) / 6 >= 60 THEN 'Af' WHEN total >= 25 * (100 - least(s, w) / 6) THEN 'Am' ELSE 'Aw' END
      ELSE CASE WHEN cold >= 0 THEN 'C' ELSE 'D' END || CASE WHEN s < w AND s / 6 < 40 AND s < w / 3 THEN 's' WHEN s >= w AND w < s / 10 THEN 'w' ELSE 'f' END
        || CASE WHEN hot >= 22 THEN 'a' WHEN (hot + cold) / 2 >= 10 THEN 'b' WHEN cold >= -38 OR cold >= 0 THEN 'c' ELSE 'd' END END AS climate FROM c""",
)
def koppen_class(spark, sf_dir):
    """Climate letters from two seasons, by the usual thresholds."""
    n = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        n.alias("cell"), ((n * 37 % 700) / 10.0 - 30).alias("ts"), ((n * 53 % 700) / 10.0 - 40).alias("tw"), (n * 29 % 1500).cast("double").alias("ps"), (n * 31 % 1300).cast("double").alias("pw")
    )
    df = df.selectExpr("cell", "greatest(ts, tw) AS hot", "least(ts, tw) AS cold", "(ts + tw) / 2 AS annual", "IF(ts >= tw, ps, pw) AS s", "IF(ts >= tw, pw, ps) AS w")
    df = df.withColumn("total", F.col("s") + F.col("w"))
    wet = F.when(F.col("total") == 0, 140).when(F.col("s") >= F.lit(0.7) * F.col("total"), 280).when(F.col("s") <= F.lit(0.3) * F.col("total"), 0).otherwise(140)
    df = df.withColumn("threshold", F.greatest(F.lit(0.0), 20 * F.col("annual") + wet))
    low = F.least("s", "w") / 6
    arid = F.concat(F.when(F.col("total") < F.col("threshold") * 0.5, "BW").otherwise("BS"), F.when(F.col("annual") < 18, "k").otherwise("h"))
    tropical = F.when(low >= 60, "Af").when(F.col("total") >= 25 * (100 - low), "Am").otherwise("Aw")
    season = F.when((F.col("s") < F.col("w")) & (F.col("s") / 6 < 40) & (F.col("s") < F.col("w") / 3), "s").when((F.col("s") >= F.col("w")) & (F.col("w") < F.col("s") / 10), "w").otherwise("f")
    heat = F.when(F.col("hot") >= 22, "a").when((F.col("hot") + F.col("cold")) / 2 >= 10, "b").when(F.col("cold") >= -38, "c").otherwise("d")
    rest = F.concat(F.when(F.col("cold") >= 0, "C").otherwise("D"), season, heat)
    climate = F.when(F.col("hot") < 0, "EF").when(F.col("hot") < 10, "ET").when(F.col("total") < F.col("threshold"), arid).when(F.col("cold") >= 18, tropical).otherwise(rest)
    return df.select("cell", climate.alias("climate"))


MONTHS_SQL = "mo AS (SELECT c_custkey AS cell, list_transform(range(12), lambda m: ((c_custkey * (m + 3) * 17) % 97)::DOUBLE / 4) AS q, ((c_custkey % 50)::DOUBLE / 10000) AS slope FROM customer)"
SECONDS_SQL = str([float(s) for s in hydrology.MONTH_SECONDS])


def months(spark, sf_dir):
    q = F.expr("transform(sequence(0, 11), m -> CAST((c_custkey * (m + 3) * 17) % 97 AS DOUBLE) / 4)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), q.alias("q"), (F.col("c_custkey") % 50 / F.lit(10000.0)).alias("slope"))


@query(
    "flow_statistics",
    f"""WITH {MONTHS_SQL} SELECT cell, round(list_sum(list_transform(range(1, 13), lambda m: q[m] * ({SECONDS_SQL})[m])) / list_sum({SECONDS_SQL}), 6) AS mean_m3s, list_min(q) AS min_month_m3s,
      (list_position(q, list_min(q)) - 1)::BIGINT AS min_month, list_max(q) AS max_month_m3s, len(list_filter(q, lambda x: x <= 0.01))::BIGINT AS dry_months FROM mo""",
)
def flow_statistics(spark, sf_dir):
    s = hydrology.flow_statistics(F.col("q"))
    s["mean_m3s"] = F.round(s["mean_m3s"], 6)
    return months(spark, sf_dir).select("cell", *(v.alias(k) for k, v in s.items()))


@query(
    "channel_hydraulics_monthly",
    f"""WITH {MONTHS_SQL}, a AS (SELECT cell, slope, m AS month, greatest(list_sum(list_transform(range(1, 13), lambda k: q[k] * ({SECONDS_SQL})[k])) / list_sum({SECONDS_SQL}), 1e-12) AS mean, q[m + 1] AS f FROM mo, unnest(range(12)) t(m)),
    b AS (SELECT *, 7.2 * sqrt(mean) * pow(f / mean, 0.26) AS w FROM a),
    c AS (SELECT *, CASE WHEN slope >= 1e-5 THEN pow(f * 0.035 / (w * sqrt(greatest(slope, 1e-5))), 0.6) ELSE 0.27 * pow(mean, 0.39) * pow(f / mean, 0.40) END AS d FROM b)
    SELECT cell, month, round(CASE WHEN f > 0 THEN w ELSE 0 END, 6)::DOUBLE AS width_m, round(CASE WHEN f > 0 THEN d ELSE 0 END, 6)::DOUBLE AS depth_m, round(CASE WHEN f > 0 THEN f / (w * d) ELSE 0 END, 6)::DOUBLE AS velocity_m_s FROM c""",
)
def channel_hydraulics_monthly(spark, sf_dir):
    """The channel of each cell in each of the twelve months (0 to 11)."""
    df = months(spark, sf_dir).withColumn("mean", hydrology.month_mean(F.col("q"))).select("cell", "mean", "slope", F.posexplode("q").alias("month", "f"))
    h = hydrology.channel(F.col("f"), F.col("mean"), F.col("slope"))
    return df.select("cell", F.col("month").cast("long").alias("month"), *(F.round(v, 6).alias(k) for k, v in h.items()))


@query(
    "suitability_trapezoid",
    """SELECT p_partkey AS cell, round(greatest(0.0, least(1.0, (p_retailprice - 900) / 300, (2000 - p_retailprice) / 500)), 6)::DOUBLE AS suitability FROM part""",
)
def suitability_trapezoid(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.round(hydrology.trapezoid(F.col("p_retailprice"), 900, 1200, 1500, 2000), 6).alias("suitability"))


@query(
    "longest_cyclic_run",
    f"""WITH {MONTHS_SQL}, b AS (SELECT cell, m, q[m % 12 + 1] > 8 AS t FROM mo, unnest(range(24)) u(m)),
    c AS (SELECT cell, m, m - row_number() OVER (PARTITION BY cell ORDER BY m) AS island FROM b WHERE t),
    d AS (SELECT cell, least(12, count(*)) AS n FROM c GROUP BY cell, island)
    SELECT mo.cell, coalesce(max(n), 0)::BIGINT AS run FROM mo LEFT JOIN d USING (cell) GROUP BY 1""",
)
def longest_cyclic_run(spark, sf_dir):
    flags = F.transform("q", lambda x: x > 8)
    return months(spark, sf_dir).select("cell", hydrology.longest_cyclic_run(flags).alias("run"))


def _balance_sql(years: int = 2) -> str:
    """The fold written out month by month, as a chain of CTEs."""
    out, last = ["y0 AS (SELECT cell, 0.0::DOUBLE AS snow, 0.0::DOUBLE AS soil, 0.0::DOUBLE AS gw, 0.0::DOUBLE AS aet, 0.0::DOUBLE AS runoff, q AS p, slope FROM mo)"], "y0"
    for n in range(12 * years):
        m = n % 12
        day = float(hydrology.MONTH_DAYS[m])
        t, e = f"((cell % 40)::DOUBLE - 12 + {6 - abs(m - 6)} * 3.0::DOUBLE)", f"(10.0::DOUBLE + {6 - abs(m - 6)} * 12)"
        start = "0.0::DOUBLE" if m == 0 else None
        out.append(f"""a{n} AS (SELECT *, {t} AS t, {e} AS e, CASE WHEN {t} <= 0 THEN p[{m + 1}] * 5 ELSE 0 END AS fall FROM {last}),
    b{n} AS (SELECT *, least(snow + fall, 3.0 * greatest(t, 0) * {day!r}) AS melt FROM a{n}),
    c{n} AS (SELECT *, greatest(snow + fall - melt - 1000, 0) AS spill FROM b{n}),
    d{n} AS (SELECT *, p[{m + 1}] * 5 - fall + melt + spill AS liquid FROM c{n}),
    e{n} AS (SELECT *, soil * exp(greatest(e - liquid, 0) / -150.0) - least(e - liquid, 0) AS wet FROM d{n}),
    f{n} AS (SELECT *, greatest(wet - 150, 0) AS surplus FROM e{n}),
    g{n} AS (SELECT *, gw + surplus * 0.3::DOUBLE AS ground, 1 - exp(-{day!r}::DOUBLE / 90) AS share FROM f{n}),
    y{n + 1} AS (SELECT cell, p, slope, snow + fall - melt - spill AS snow, wet - surplus AS soil, ground - ground * share AS gw,
      {start or 'aet'} + liquid + soil - wet AS aet, {start or 'runoff'} + surplus * 0.7::DOUBLE + ground * share AS runoff FROM g{n})""")
        last = f"y{n + 1}"
    return f"WITH {MONTHS_SQL}, {', '.join(out)} SELECT cell, " + ", ".join(f"round({c}, 4)::DOUBLE AS {c}" for c in ("snow", "soil", "gw", "aet", "runoff")) + f" FROM {last}"


@query("monthly_water_balance", _balance_sql())
def monthly_water_balance(spark, sf_dir):
    """The snow, soil and groundwater state after two years from empty stores, which
    need not have settled; see ``periodic_water_balance``."""
    df = climate(spark, sf_dir)
    df = df.withColumn("s", monthly.water_year(F.col("temp"), F.col("rain"), F.col("pet"), 2))
    return df.select("cell", *(F.round(f"s.{c}", 4).alias(c) for c in ("snow", "soil", "gw", "aet", "runoff")))


def climate(spark, sf_dir):
    return months(spark, sf_dir).select(
        "cell", F.expr("transform(q, x -> x * 5)").alias("rain"),
        F.expr("transform(sequence(0, 11), m -> CAST(cell % 40 AS DOUBLE) - 12 + (6 - abs(m - 6)) * 3.0D)").alias("temp"),
        F.expr("transform(sequence(0, 11), m -> 10.0D + (6 - abs(m - 6)) * 12)").alias("pet"),
    )


@query("periodic_water_balance")
def periodic_water_balance(spark, sf_dir):
    """The snow, soil and groundwater state that a year returns to; what it still changes
    them by is returned."""
    df = climate(spark, sf_dir).withColumn("s", monthly.periodic_year(F.col("temp"), F.col("rain"), F.col("pet")))
    return df.select("cell", *(F.round(f"s.{c}", 4).alias(c) for c in ("snow", "soil", "gw", "aet", "runoff", "change")))


# ---- audits and selection ------------------------------------------------------------

SAMPLES_SQL = """s AS (SELECT d.doc_id, CASE WHEN d.doc_id % 50 = 0 THEN 'val' ELSE 'train' END AS split, d.lang AS profile, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' ELSE 'plain' END AS kind, d.text
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def samples(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("plain")
    return d.join(lab, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "val").otherwise("train").alias("split"), F.col("lang").alias("profile"), kind.alias("kind"), "text")


@query("split_leakage", f"WITH {SAMPLES_SQL}, h AS (SELECT doc_id, split, sha256(text) AS digest FROM s) SELECT v.doc_id, v.digest FROM h v WHERE split = 'val' AND digest IN (SELECT digest FROM h WHERE split = 'train')")
def split_leakage(spark, sf_dir):
    """Validation texts that are also training texts."""
    h = samples(spark, sf_dir).select("doc_id", "split", F.sha2("text", 256).alias("digest"))
    return h.filter("split = 'val'").join(h.filter("split = 'train'").select("digest"), "digest", "left_semi").select("doc_id", "digest")


@query("dataset_triples", "SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) >= 3")
def dataset_triples(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles"), F.count("*").alias("turns")).filter("turns >= 3")


@query("rare_quota_select", f"WITH {SAMPLES_SQL} SELECT split, kind, doc_id, row_number() OVER (PARTITION BY split, kind ORDER BY length(text) DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5")
def rare_quota_select(spark, sf_dir):
    """The five longest samples of each split and kind."""
    w = Window.partitionBy("split", "kind").orderBy(F.col("n").desc(), "doc_id")
    return samples(spark, sf_dir).withColumn("n", F.char_length("text")).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("split", "kind", "doc_id", "rank")


@query("coverage_cube", f"WITH {SAMPLES_SQL} SELECT split, profile, kind, count(*) AS n FROM s GROUP BY CUBE (split, profile, kind)")
def coverage_cube(spark, sf_dir):
    return samples(spark, sf_dir).cube("split", "profile", "kind").agg(F.count("*").alias("n"))


@query("duplicate_digest", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


# ---- serving ---------------------------------------------------------------------


@query(
    "lru_evict",
    f"""WITH {fx.REQUESTS_SQL}, a AS (SELECT session, key, max(ts) AS accessed, sum(1 + event_id % 50)::BIGINT AS bytes FROM q GROUP BY 1, 2),
    b AS (SELECT *, sum(bytes) OVER (PARTITION BY session ORDER BY accessed DESC, key ROWS UNBOUNDED PRECEDING) AS kept FROM a)
    SELECT session, key, bytes FROM b WHERE kept > 600""",
)
def lru_evict(spark, sf_dir):
    """Per session, the groups beyond 600 bytes, latest accessed kept first."""
    a = fx.requests(spark, sf_dir).groupBy("session", "key").agg(F.max("ts").alias("accessed"), F.sum(1 + F.col("event_id") % 50).alias("bytes"))
    w = Window.partitionBy("session").orderBy(F.col("accessed").desc(), "key").rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn("kept", F.sum("bytes").over(w)).filter("kept > 600").select("session", "key", "bytes")


@query(
    "job_rank_all",
    f"""WITH {fx.REQUESTS_SQL}, p AS (SELECT session, event_id, event_id * 7 % 3000 AS priority, least(50, key) AS age FROM q)
    SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY priority // 1000, priority % 1000 - age, event_id)::INTEGER AS rank FROM p""",
)
def job_rank_all(spark, sf_dir):
    """Every job's rank in its session: by band, then by priority less age (at most 50),
    then by sequence. Two-level running counts, so a session may be larger than a task."""
    priority, age = F.col("event_id") * 7 % 3000, F.least(F.lit(50), "key")
    p = fx.requests(spark, sf_dir).select("session", "event_id", F.floor(priority / 1000).alias("band"), (priority % 1000 - age).alias("wait"), F.lit(1).alias("one"))
    ranked = st.running_totals(p, "session", [F.col("band"), F.col("wait"), F.col("event_id")], "one")
    return ranked.select("session", "event_id", (F.col("_before") + 1).cast("int").alias("rank"))


@query(
    "session_expiry_ttl",
    f"""WITH {fx.REQUESTS_SQL}, a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM q),
    b AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a)
    SELECT session, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 6 HOUR) AS expires, count(*) AS requests FROM b GROUP BY session, s""",
)
def session_expiry_ttl(spark, sf_dir):
    s = serving.sessions(fx.requests(spark, sf_dir), "6 hours")
    return s.select("session", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("expires").cast("timestamp")).alias("expires"), "requests")


@query("latest_epoch_wins", f"WITH {fx.REQUESTS_SQL} SELECT session, max(event_id // 100) AS epoch, arg_max(key, (event_id // 100) * 1000000000 + event_id) AS key FROM q GROUP BY 1")
def latest_epoch_wins(spark, sf_dir):
    r = fx.requests(spark, sf_dir)
    return serving.latest_epoch(r.select("session", F.expr("event_id div 100").alias("epoch"), F.col("event_id").alias("ts"), "key")).select("session", "epoch", "key")


@query("job_dedup", f"WITH {fx.REQUESTS_SQL} SELECT session, key, epoch_us(min(ts)) AS first FROM q GROUP BY 1, 2")
def job_dedup(spark, sf_dir):
    return serving.first_by_key(fx.requests(spark, sf_dir)).select("session", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("first"))


@query("progress_stage_agg", f"WITH {fx.REQUESTS_SQL} SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS started, kind, count(*) AS n FROM q GROUP BY 1, 2")
def progress_stage_agg(spark, sf_dir):
    return serving.stage_counts(fx.requests(spark, sf_dir), "1 hour").select(F.unix_micros(F.col("started").cast("timestamp")).alias("started"), "kind", "n")


@query("json_legend", "SELECT event_type AS kind, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS high, count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
def json_legend(spark, sf_dir):
    return fx.requests(spark, sf_dir).groupBy("kind").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.countDistinct("key").alias("n"))


@query(
    "rect_subtract",
    """WITH a AS (SELECT p_partkey AS id, p_partkey % 20 AS x0, p_partkey % 17 AS y0, p_partkey % 20 + p_size AS x1, p_partkey % 17 + p_size AS y1 FROM part),
    b AS (SELECT *, greatest(x0, 15) AS ix0, greatest(y0, 12) AS iy0, least(x1, 25) AS ix1, least(y1, 22) AS iy1 FROM a)
    SELECT id, piece, px0, py0, px1, py1 FROM (
      SELECT id, 0 AS piece, x0 AS px0, y0 AS py0, x1 AS px1, y1 AS py1 FROM b WHERE ix0 >= ix1 OR iy0 >= iy1
      UNION ALL SELECT id, 1, x0, y0, x1, iy0 FROM b WHERE ix0 < ix1 AND iy0 < iy1
      UNION ALL SELECT id, 2, x0, iy1, x1, y1 FROM b WHERE ix0 < ix1 AND iy0 < iy1
      UNION ALL SELECT id, 3, x0, iy0, ix0, iy1 FROM b WHERE ix0 < ix1 AND iy0 < iy1
      UNION ALL SELECT id, 4, ix1, iy0, x1, iy1 FROM b WHERE ix0 < ix1 AND iy0 < iy1) WHERE px0 < px1 AND py0 < py1""",
)
def rect_subtract(spark, sf_dir):
    """Rectangles less a protected one: at most four pieces, exploded from one row."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 20 AS x0", "p_partkey % 17 AS y0", "p_partkey % 20 + p_size AS x1", "p_partkey % 17 + p_size AS y1")
    df = df.selectExpr("*", "greatest(x0, 15) AS ix0", "greatest(y0, 12) AS iy0", "least(x1, 25) AS ix1", "least(y1, 22) AS iy1")
    pieces = [(1, "x0", "y0", "x1", "iy0"), (2, "x0", "iy1", "x1", "y1"), (3, "x0", "iy0", "ix0", "iy1"), (4, "ix1", "iy0", "x1", "iy1")]
    box = lambda k, *c: F.struct(F.lit(k).alias("piece"), *(F.col(x).cast("long").alias(n) for x, n in zip(c, ("px0", "py0", "px1", "py1"), strict=True)))
    apart = (F.col("ix0") >= F.col("ix1")) | (F.col("iy0") >= F.col("iy1"))
    all_pieces = F.when(apart, F.array(box(0, "x0", "y0", "x1", "y1"))).otherwise(F.array(*(box(*p) for p in pieces)))
    return df.select("id", F.explode(all_pieces).alias("p")).select("id", "p.*").filter("px0 < px1 AND py0 < py1")


# ---- engine built-ins over the same tables ----------------------------------------------


@query("grouping_sets_cover", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_cover(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("q"))
    return df.groupingSets([["flag", "status"], ["flag"], []], "flag", "status").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("rollup_sales", "SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup_sales(spark, sf_dir):
    df = (
        table(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").cast("long").alias("v"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return df.rollup(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("approx_distinct")
def approx_distinct(spark, sf_dir):
    """HyperLogLog estimate of distinct parts by flag."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
