"""Queries over places, climate formulas, stencils, losses and checks of fields."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.functions import climate, geography, hydrology, keys
from quillgrid.operators import graph, raster, routing, spatial
from quillgrid.operators import statistics as st
from quillgrid.plans import fixtures as fx
from quillgrid.plans.catalogue import DRAW, MONTHS_SQL, ORACLES, SECONDS_SQL, connected_components, months, query
from quillgrid.sources.tables import table

WORLD = geography.World(-20e6, -10e6, 20e6, 10e6, 512, 1024)
FLAT = geography.World(-20e6, -10e6, 20e6, 10e6, 512, 1024, round=False)


def rounded(columns: dict, digits: int = 6) -> list:
    return [F.round(v, digits).alias(k) for k, v in columns.items()]


# ---- places -------------------------------------------------------------------------


@query(
    "world_places",
    """WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919 % 60000) * 1000 - 30000000)::DOUBLE AS x, ((o_custkey * 104729 % 24000) * 1000 - 12000000)::DOUBLE AS y FROM orders),
    q AS (SELECT *, greatest(least(floor((y + 1e7) / (2e7 / 512)), 511), 0)::BIGINT AS row, floor((x + 2e7) / (4e7 / 1024))::BIGINT AS col FROM p)
    SELECT id, row * 1024 + ((col % 1024) + 1024) % 1024 AS cell, row * 1024 + greatest(least(col, 1023), 0) AS flat_cell,
      round(90 - (y + 1e7) / 2e7 * 180, 6) AS latitude, round(least(greatest(-y * 90 / 1e7, -90.0::DOUBLE), 90.0::DOUBLE), 6) AS climate_latitude, round(x * 0.5::DOUBLE, 6) AS atlas_x,
      least(greatest(x, -2e7), 2e7) AS flat_x, least(greatest(y, -1e7), 1e7) AS held_y,
      round(-2e7 + (((col % 1024) + 1024) % 1024 + 0.5::DOUBLE) * (4e7 / 1024), 6) AS centre_x, round(-1e7 + (row + 0.5::DOUBLE) * (2e7 / 512), 6) AS centre_y FROM q""",
)
def world_places(spark, sf_dir):
    """Cells, latitudes, clipped and rescaled coordinates and cell centres of places."""
    x, y = F.col("x"), F.col("y")
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 60000 * 1000 - 30_000_000).cast("double").alias("x"), (F.col("o_custkey") * 104729 % 24000 * 1000 - 12_000_000).cast("double").alias("y")
    )
    p = p.withColumn("cell", WORLD.cell(x, y))
    cx, cy = WORLD.centre(F.col("cell"))
    flat_x, held_y = FLAT.clip(x, y)
    return p.select(
        "id", "cell", FLAT.cell(x, y).alias("flat_cell"),
        *rounded({"latitude": WORLD.latitude(y), "climate_latitude": geography.climate_latitude(y), "atlas_x": geography.stretched(x, 40e6, 20e6)}),
        flat_x.alias("flat_x"), held_y.alias("held_y"), *rounded({"centre_x": cx, "centre_y": cy}),
    )


@query(
    "boxes_meeting",
    """WITH a AS (SELECT p_partkey AS id, p_partkey * 7919 % 4000 - 2000 AS x0, p_partkey * 104729 % 2000 - 1000 AS y0, p_size AS w FROM part),
    b AS (SELECT s_suppkey AS ask, s_suppkey * 331 % 4000 - 2000 + s AS x0, s_suppkey * 577 % 2000 - 1000 AS y0 FROM supplier, unnest([-4000, 0, 4000]) t(s))
    SELECT ask, count(*) AS boxes, sum(id)::BIGINT AS ids FROM a JOIN b ON a.x0 < b.x0 + 300 AND b.x0 < a.x0 + w AND a.y0 < b.y0 + 200 AND b.y0 < a.y0 + w GROUP BY 1""",
)
def boxes_meeting(spark, sf_dir):
    """Boxes that overlap each asked box on a world that wraps."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 4000 - 2000).alias("x0"), (F.col("p_partkey") * 104729 % 2000 - 1000).alias("y0"), "p_size")
    a = a.select("id", "x0", "y0", (F.col("x0") + F.col("p_size")).alias("x1"), (F.col("y0") + F.col("p_size")).alias("y1"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 331 % 4000 - 2000).alias("x0"), (F.col("s_suppkey") * 577 % 2000 - 1000).alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + 300, "y1": F.col("y0") + 200})
    return spatial.meeting_totals(a, b, 128, 4000)


def _mix_sql(x: str) -> str:
    """The 32-bit mix as one DuckDB expression over a list of one."""
    m = "4294967296::HUGEINT"
    out = f"[({x})::HUGEINT]"
    for shift, factor in ((16, geography.MIX_A), (15, geography.MIX_B), (16, 1)):
        out = f"list_transform({out}, lambda v: (xor(v::BIGINT, v::BIGINT >> {shift})::HUGEINT * {factor}) % {m})"
    return f"({out})[1]::BIGINT"


@query(
    "sample_hashes",
    f"""WITH a AS (SELECT o_orderkey AS id, ((o_orderkey - 7000)::HUGEINT & 4294967295::HUGEINT) AS i, ((o_custkey - 500)::HUGEINT & 4294967295::HUGEINT) AS j FROM orders),
    b AS (SELECT *, {_mix_sql(f"(j + {geography.SPREAD_J}) % 4294967296::HUGEINT")} AS hj FROM a),
    c AS (SELECT *, xor(xor(((i * {geography.SPREAD_I}) % 4294967296::HUGEINT)::BIGINT, hj), 77::BIGINT) AS x FROM b)
    SELECT id, {_mix_sql("x")} AS hash FROM c""",
)
def sample_hashes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geography.sample_hash(F.col("o_orderkey") - 7000, F.col("o_custkey") - 500, 77).alias("hash"))


@query(
    "scalar_maps",
    """WITH a AS (SELECT p_partkey AS cell, p_retailprice AS v, greatest(least((p_retailprice - 900) / 1000, 1.0::DOUBLE), 0.0::DOUBLE) AS t, (p_retailprice - 1500) / 500 AS e FROM part)
    SELECT cell, round(t * t * (3 - 2 * t), 6) AS smooth, round(sign(v - 1500) * sqrt(abs(v - 1500)), 6) AS root,
      round(CASE WHEN e <= 0 THEN e * 10 ELSE 6 * pow(least(e, 1.0::DOUBLE), 4) * (5 - 4 * least(e, 1.0::DOUBLE)) END, 6) AS km FROM a""",
)
def scalar_maps(spark, sf_dir):
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cell"), *rounded({"smooth": geography.smoothstep(900, 1900, v), "root": geography.signed_root(v - 1500), "km": geography.height_km((v - 1500) / 500)})
    )


RAMP = ("102040", "3080C0", "F0E0A0", "FFFFFF")


@query(
    "colour_ramp",
    f"""WITH a AS (SELECT p_partkey AS cell, least(greatest((p_retailprice - 950) / 900, 0.0::DOUBLE), 1.0::DOUBLE) * 3 AS spot FROM part), b AS (SELECT *, least(floor(spot), 2)::INTEGER AS k FROM a)
    SELECT cell, {', '.join(f"round(({[geography.colour(s)[c] for s in RAMP]!r}::DOUBLE[])[k + 1] * (1 - (spot - k)) + ({[geography.colour(s)[c] for s in RAMP]!r}::DOUBLE[])[k + 2] * (spot - k), 6) AS {n}" for c, n in enumerate(('red', 'green', 'blue')))} FROM b""",
)
def colour_ramp(spark, sf_dir):
    t = (F.col("p_retailprice") - 950) / 900
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), *rounded(dict(zip(("red", "green", "blue"), geography.ramp(t, RAMP), strict=True))))


# ---- weights and choices ---------------------------------------------------------------


@query(
    "weight_quanta",
    """WITH a AS (SELECT o_custkey % 50 AS parent, o_orderkey AS child, CASE WHEN o_custkey % 50 % 9 = 0 THEN 0.0 ELSE floor(o_totalprice) % 1000 END::DOUBLE AS w, o_totalprice AS v FROM orders), b AS (SELECT *, max(w) OVER (PARTITION BY parent) AS top FROM a)
    SELECT parent, child, CASE WHEN w > 0 THEN greatest(floor(w / top * 1048576), 1) ELSE 0 END::BIGINT AS weight, round_even(v / 0.25, 0)::BIGINT AS quanta FROM b""",
)
def weight_quanta(spark, sf_dir):
    """Integer weights of children by their parent's greatest, and values as whole quanta (ties to even)."""
    parent = F.col("o_custkey") % 50
    a = table(spark, sf_dir, "orders").select(
        parent.alias("parent"), F.col("o_orderkey").alias("child"), F.when(parent % 9 == 0, 0.0).otherwise((F.floor("o_totalprice") % 1000).cast("double")).alias("w"), F.col("o_totalprice").alias("v")
    )
    top = a.groupBy("parent").agg(F.max("w").alias("top"))
    return a.join(top, "parent").select("parent", "child", geography.quantised(F.col("w"), F.col("top")).alias("weight"), F.rint(F.col("v") / 0.25).cast("long").alias("quanta"))


@query(
    "placement_cumulative",
    """WITH a AS (SELECT o_custkey % 50 AS parent, o_orderkey AS child, CASE WHEN o_custkey % 50 % 7 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT % 100 END AS w FROM orders),
    b AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY parent) = 0 THEN 1 ELSE w END AS u FROM a)
    SELECT parent, child, sum(u) OVER (PARTITION BY parent ORDER BY child)::BIGINT AS upto FROM b""",
)
def placement_cumulative(spark, sf_dir):
    """Running weights of each parent's children, alike where all are zero; a parent may be larger than a task."""
    parent = F.col("o_custkey") % 50
    a = table(spark, sf_dir, "orders").select(parent.alias("parent"), F.col("o_orderkey").alias("child"), F.when(parent % 7 == 0, 0).otherwise(F.floor("o_totalprice").cast("long") % 100).alias("w"))
    none = a.groupBy("parent").agg((F.sum("w") == 0).alias("none"))
    a = a.join(none, "parent").select("parent", "child", F.when(F.col("none"), 1).otherwise(F.col("w")).cast("long").alias("w"))
    return st.running_totals(a, "parent", [F.col("child")], "w").select("parent", "child", (F.col("_before") + F.col("w")).alias("upto"))


@query("expanded_counts", "SELECT s_suppkey AS cell, k AS index FROM supplier, unnest(range(s_suppkey % 6)) t(k)")
def expanded_counts(spark, sf_dir):
    """Each cell as often as its count says, numbered from 0."""
    n = (F.col("s_suppkey") % 6).cast("int")
    return table(spark, sf_dir, "supplier").filter(n > 0).select(F.col("s_suppkey").alias("cell"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("index"))


@query(
    "class_choice",
    f"""WITH {fx.draw_sql("orders", "o_orderkey", keys.key(42, DRAW))},
    a AS (SELECT o_orderkey AS cell, (k >> 11)::DOUBLE / 9007199254740992.0 AS u, [(o_orderkey * m * 31 + o_custkey) % 97 FOR m IN [1, 2, 3, 5]] AS s FROM d3)
    SELECT cell, (list_position(s, list_max(s)) - 1)::BIGINT AS best, CASE WHEN list_sum(s) = 0 THEN NULL ELSE (SELECT count(*) FROM unnest(range(1, 5)) t(n) WHERE list_sum(s[1:n]) <= u * list_sum(s)) END::BIGINT AS drawn FROM a""",
)
def class_choice(spark, sf_dir):
    """The class with the greatest score (the first of several), and one drawn by key with scores as weights."""
    s = F.array(*((F.col("o_orderkey") * m * 31 + F.col("o_custkey")) % 97 for m in (1, 2, 3, 5)))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), keys.to_unit(keys.cell_key(42, DRAW, F.col("o_orderkey"))).alias("u"), s.alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda x, y: x + y)
    drawn = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.aggregate(F.slice("s", F.lit(1), n), F.lit(0).cast("long"), lambda x, y: x + y)), lambda c: c <= F.col("u") * total))
    return a.select("cell", (F.array_position("s", F.array_max("s")) - 1).cast("long").alias("best"), F.when(total > 0, drawn).cast("long").alias("drawn"))


# ---- climate -----------------------------------------------------------------------------

MID_SQL, DAYS_SQL = (str([float(x) for x in v]) + "::DOUBLE[]" for v in (climate.MID_MONTH_DAY, hydrology.MONTH_DAYS))


def _daylight_sql(phi: str, delta: str) -> str:
    h = f"acos(least(greatest(-tan({phi}) * tan({delta}), -1.0::DOUBLE), 1.0::DOUBLE))"
    return f"({h} * sin({phi}) * sin({delta}) + cos({phi}) * cos({delta}) * sin({h}))"


@query(
    "solar_year",
    f"""WITH a AS (SELECT c_custkey AS cell, m, (c_custkey % 181 - 90)::DOUBLE AS lat, (c_custkey % 40 - 15 + m)::DOUBLE AS t, 2 * pi() * ({MID_SQL})[m + 1] / 365 AS g FROM customer, unnest(range(12)) u(m)),
    b AS (SELECT *, radians(least(greatest(lat, -89.9::DOUBLE), 89.9::DOUBLE)) AS phi, 0.409::DOUBLE * sin(g - 1.39::DOUBLE) AS d FROM a),
    c AS (SELECT *, greatest(24 * 60 / pi() * 0.0820::DOUBLE * (1 + 0.033::DOUBLE * cos(g)) * {_daylight_sql('phi', 'd')}, 0) AS ra FROM b)
    SELECT cell, m AS month, round(ra, 6) AS radiation, round(ra * greatest(t + 5, 0) / 245 * ({DAYS_SQL})[m + 1], 6) AS pet, round(1361.0::DOUBLE / pi() * {_daylight_sql('phi', 'd')}, 4) AS insolation FROM c""",
)
def solar_year(spark, sf_dir):
    """Radiation and potential evapotranspiration by latitude and month."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    lat, t = (F.col("cell") % 181 - 90).cast("double"), (F.col("cell") % 40 - 15 + F.col("m")).cast("double")
    delta = climate.TILT * F.sin(2 * pi * climate.by_month(climate.MID_MONTH_DAY, F.col("m")) / 365 - climate.PHASE)
    return a.select(
        "cell", F.col("m").cast("long").alias("month"), *rounded({"radiation": climate.radiation(lat, F.col("m")), "pet": climate.evaporation(t, lat, F.col("m"))}),
        F.round(climate.insolation(F.radians(climate.hold(lat, -89.9, 89.9)), delta), 4).alias("insolation"),
    )


@query(
    "bioclim_seasons",
    """WITH a AS (SELECT c_custkey AS cell, (c_custkey % 50)::DOUBLE AS ts, (c_custkey % 37 - 20)::DOUBLE AS tw, (c_custkey * 17 % 900)::DOUBLE AS ps, (c_custkey * 29 % 700)::DOUBLE AS pw FROM customer)
    SELECT cell, round((ts + tw) / 2, 6) AS bio1, round(abs(ts - tw) * 100 * sqrt(12.0 / 11) / (2 * sqrt(2.0)), 6) AS bio4, round(ps + pw, 6) AS bio12, round(abs(ps - pw) * 100 * sqrt(12.0 / 11) / (ps + pw + 12), 6) AS bio15,
      round(least(greatest(-6.5::DOUBLE + 0.0015::DOUBLE * (ps + pw), -9.8::DOUBLE), -4.0::DOUBLE) / 1000, 9) AS lapse FROM a""",
)
def bioclim_seasons(spark, sf_dir):
    c = F.col("c_custkey")
    ts, tw, ps, pw = ((c % 50).cast("double"), (c % 37 - 20).cast("double"), (c * 17 % 900).cast("double"), (c * 29 % 700).cast("double"))
    return table(spark, sf_dir, "customer").select(c.alias("cell"), *rounded(climate.bioclim(ts, tw, ps, pw)), F.round(climate.lapse_rate(ps + pw), 9).alias("lapse"))


@query(
    "flow_regimes",
    f"""WITH {MONTHS_SQL}, a AS (SELECT cell, CASE WHEN cell % 7 = 0 THEN []::DOUBLE[] WHEN cell % 5 = 0 THEN list_transform(q, lambda x: 3.0::DOUBLE) WHEN cell % 3 = 0 THEN list_transform(q, lambda x: CASE WHEN x < 14 THEN 0.0::DOUBLE ELSE x END) ELSE q END AS q,
      CASE WHEN cell % 2 = 0 THEN 0.001 ELSE list_sum(list_transform(range(1, 13), lambda m: q[m] * ({SECONDS_SQL})[m])) / list_sum({SECONDS_SQL}) END AS annual FROM mo),
    b AS (SELECT *, len(list_filter(q, lambda x: x < 0.01)) AS dry FROM a)
    SELECT cell, CASE WHEN len(q) = 12 THEN CASE WHEN dry >= 6 THEN 'ephemeral' WHEN dry > 0 THEN 'seasonal' WHEN list_max(q) - list_min(q) <= 0 THEN 'unresolved' ELSE 'perennial' END WHEN annual < 0.01 THEN 'ephemeral' ELSE 'unresolved' END AS regime FROM b""",
)
def flow_regimes(spark, sf_dir):
    mo = months(spark, sf_dir).withColumn("annual", F.when(F.col("cell") % 2 == 0, 0.001).otherwise(hydrology.month_mean(F.col("q"))))
    q = F.when(F.col("cell") % 7 == 0, F.array().cast("array<double>")).when(F.col("cell") % 5 == 0, F.transform("q", lambda x: F.lit(3.0)))
    q = q.when(F.col("cell") % 3 == 0, F.transform("q", lambda x: F.when(x < 14, 0.0).otherwise(x))).otherwise(F.col("q"))
    return mo.withColumn("q", q).select("cell", climate.flow_regime(F.col("q"), F.col("annual")).alias("regime"))


# ---- stencils ------------------------------------------------------------------------------

#: The last row of the grid may lack cells: weights are over the cells that there are.
WHOLE_SQL = f"{fx.GRID_SQL}, gw AS (SELECT r, c, z FROM g), hh AS (SELECT max(r) + 1 AS h FROM gw)"


def whole_grid(spark, sf_dir):
    """The grid and the number of its rows."""
    g = fx.grid(spark, sf_dir)
    return g.select("r", "c", "z"), (g.agg(F.max("r")).first()[0] or 0) + 1


def _gaussian_sql(source: str, name: str, sigma: float, modes: tuple[str, str] = ("reflect", "reflect"), value: str = "z") -> str:
    """CTEs that end in ``name`` (r, c, z): the two passes as joins with a list of taps."""
    w = raster.taps(sigma)
    n = len(w) // 2
    place = {
        "reflect": lambda i, s: f"least((({i}) % (2 * {s}) + 2 * {s}) % (2 * {s}), 2 * {s} - 1 - (({i}) % (2 * {s}) + 2 * {s}) % (2 * {s}))",
        "nearest": lambda i, s: f"greatest(least({i}, {s} - 1), 0)", "wrap": lambda i, s: f"(({i}) % {s} + {s}) % {s}",
    }
    t = f"(SELECT k - {n} AS k, ({w!r}::DOUBLE[])[k + 1] AS w FROM unnest(range({len(w)})) u(k))"
    return f"""{name}0 AS (SELECT a.r, a.c, sum(t.w * b.{value}) / sum(t.w) AS z FROM {source} a, hh, {t} t JOIN {source} b ON b.c = a.c AND b.r = {place[modes[0]]('a.r + t.k', 'hh.h')} GROUP BY 1, 2),
    {name} AS (SELECT a.r, a.c, sum(t.w * b.z) / sum(t.w) AS z FROM {name}0 a, {t} t JOIN {name}0 b ON b.r = a.r AND b.c = {place[modes[1]]('a.c + t.k', '64')} GROUP BY 1, 2)"""


def _gradient_sql(source: str, name: str, spacing: float) -> str:
    along = lambda line, axis: f"(coalesce(lead(z) OVER (PARTITION BY {line} ORDER BY {axis}), z) - coalesce(lag(z) OVER (PARTITION BY {line} ORDER BY {axis}), z)) / ((CASE WHEN lead(z) OVER (PARTITION BY {line} ORDER BY {axis}) IS NULL OR lag(z) OVER (PARTITION BY {line} ORDER BY {axis}) IS NULL THEN 1 ELSE 2 END) * {spacing!r}::DOUBLE)"
    return f"{name} AS (SELECT r, c, z, {along('r', 'c')} AS dx, {along('c', 'r')} AS dy FROM {source})"


@query(
    "terrain_derivatives",
    f"""WITH {WHOLE_SQL}, {_gaussian_sql('gw', 's', 1.2)}, {_gaussian_sql('gw', 'l', 6.0)}, {_gradient_sql('gw', 'd', 30.0)}
    SELECT r, c, round(dx, 6) AS dx, round(dy, 6) AS dy, round((s.z - l.z) / 180, 6) AS position FROM d JOIN s USING (r, c) JOIN l USING (r, c)""",
)
def terrain_derivatives(spark, sf_dir):
    """Gradient, and the height of the near over the wider surroundings."""
    g, rows = whole_grid(spark, sf_dir)
    both = raster.gaussian(g, {"_near": 1.2, "_wide": 6.0}, rows, 64)
    return raster.gradient(g, 30.0).join(both, ["r", "c"]).select("r", "c", *rounded({"dx": F.col("dx"), "dy": F.col("dy"), "position": (F.col("_near") - F.col("_wide")) / 180}))


LIGHT = (sin(radians(315)) * cos(radians(45)), -cos(radians(315)) * cos(radians(45)), sin(radians(45)))


@query(
    "hillshade",
    f"""WITH {WHOLE_SQL}, {_gaussian_sql('gw', 's', 1.2)}, {_gaussian_sql('gw', 'l', 6.0)}, {_gradient_sql('s', 'ds', 30.0)}, {_gradient_sql('l', 'dl', 30.0)},
    h AS (SELECT r, c, """
    + ", ".join(f"least(greatest((6 * {a}.dx * {LIGHT[0]!r}::DOUBLE + 6 * {a}.dy * {LIGHT[1]!r}::DOUBLE + {LIGHT[2]!r}::DOUBLE) / sqrt(36 * {a}.dx * {a}.dx + 36 * {a}.dy * {a}.dy + 1), 0.0::DOUBLE), 1.0::DOUBLE) AS {a}_" for a in ("ds", "dl"))
    + " FROM ds JOIN dl USING (r, c)) SELECT r, c, round(0.35::DOUBLE + 0.65::DOUBLE * pow(0.75::DOUBLE * dl_ + 0.25::DOUBLE * ds_, 0.85::DOUBLE), 6) AS light FROM h",
)
def hillshade(spark, sf_dir):
    """Light on the land: three quarters from the wide form, one from the near."""
    g, rows = whole_grid(spark, sf_dir)
    d = raster.gaussian(g, {"_wide": 6.0, "_near": 1.2}, rows, 64)
    for name in ("_wide", "_near"):
        d = raster.gradient(d, 30.0, name).withColumn(name, raster.shade(F.col("dx"), F.col("dy"), LIGHT, 6.0))
    light = 0.35 + 0.65 * F.pow(0.75 * F.col("_wide") + 0.25 * F.col("_near"), F.lit(0.85))
    return d.select("r", "c", F.round(light, 6).alias("light"))


@query(
    "height_moments",
    f"""WITH {WHOLE_SQL}, q AS (SELECT r, c, z, z * z AS z2 FROM gw), {_gaussian_sql('q', 'm1', 1.5, ('nearest', 'wrap'))}, {_gaussian_sql('q', 'm2', 1.5, ('nearest', 'wrap'), 'z2')}
    SELECT r, c, round(m1.z, 4) AS mean, round(m2.z, 2) AS square FROM m1 JOIN m2 USING (r, c)""",
)
def height_moments(spark, sf_dir):
    """Smoothed height and squared height; rows are held at the poles, columns wrap."""
    g, rows = whole_grid(spark, sf_dir)
    modes = ("nearest", "wrap")
    one = raster.gaussian(g, {"z": 1.5}, rows, 64, modes=modes).select("r", "c", F.round("z", 4).alias("mean"))
    two = raster.gaussian(g.withColumn("z", F.col("z") * F.col("z")), {"z": 1.5}, rows, 64, modes=modes).select("r", "c", F.round("z", 2).alias("square"))
    return one.join(two, ["r", "c"])


@query(
    "exact_distance",
    f"""WITH {WHOLE_SQL}, w AS (SELECT r, c FROM gw WHERE z < -900)
    SELECT gw.r, gw.c, min((gw.r - w.r) * (gw.r - w.r) + least(abs(gw.c - w.c), 64 - abs(gw.c - w.c)) * least(abs(gw.c - w.c), 64 - abs(gw.c - w.c)))::BIGINT AS d2 FROM gw LEFT JOIN w ON true GROUP BY 1, 2""",
)
def exact_distance(spark, sf_dir):
    """Squared distance of every cell to the nearest deep one, round the world."""
    g, _ = whole_grid(spark, sf_dir)
    return raster.squared_distance(g, F.col("z") < -900, 64).select("r", "c", F.col("d2").cast("long").alias("d2"))


@query("tile_relief", f"WITH {fx.GRID_SQL} SELECT r // 16 AS tr, c // 16 AS tc, min(z) AS low, max(z) AS high FROM g WHERE r % 16 BETWEEN 2 AND 13 AND c % 16 BETWEEN 2 AND 13 GROUP BY 1, 2")
def tile_relief(spark, sf_dir):
    """Least and greatest height of each tile's inside, without a halo of two cells."""
    inside = lambda x: (F.col(x) % 16).between(2, 13)
    return fx.grid(spark, sf_dir).filter(inside("r") & inside("c")).groupBy(F.expr("r div 16").alias("tr"), F.expr("c div 16").alias("tc")).agg(F.min("z").alias("low"), F.max("z").alias("high"))


# ---- routing and regions ----------------------------------------------------------------------


def _loss_sql(depth: int = 16) -> str:
    """Levels by depth, the deepest first, written out."""
    out = []
    for k in range(depth - 1, -1, -1):
        given = f"(SELECT receiver, month, sum(outflow) AS s FROM s{k + 1} GROUP BY 1, 2)" if k < depth - 1 else "(SELECT 0::BIGINT AS receiver, 0::BIGINT AS month, 0::HUGEINT AS s WHERE false)"
        out.append(f"""s{k} AS (SELECT n.cell, n.receiver, n.month, coalesce(s, 0)::BIGINT AS inflow, least(n.loss, coalesce(s, 0) + n.lateral)::BIGINT AS loss, (coalesce(s, 0) + n.lateral - least(n.loss, coalesce(s, 0) + n.lateral))::BIGINT AS outflow
      FROM n LEFT JOIN {given} x ON x.receiver = n.cell AND x.month = n.month WHERE n.depth = {k})""")
    return f"""WITH RECURSIVE {fx.FOREST_SQL}, dp AS (SELECT cell, cell AS at, 0 AS depth FROM f UNION ALL SELECT dp.cell, f.receiver, depth + 1 FROM dp JOIN f ON f.cell = dp.at WHERE f.receiver IS NOT NULL),
    n AS (SELECT f.cell, f.receiver, m AS month, (f.cell * (m + 1)) % 10 AS lateral, (f.cell * 3 + m) % 40 AS loss, d.depth FROM f JOIN (SELECT cell, max(depth) AS depth FROM dp GROUP BY 1) d USING (cell), unnest(range(12)) t(m)), {', '.join(out)}
    SELECT cell, month, inflow, loss, outflow FROM ({' UNION ALL '.join(f'FROM s{k}' for k in range(depth))})"""


@query("route_monthly_loss", _loss_sql())
def route_monthly_loss(spark, sf_dir):
    """Monthly volumes routed downstream, each cell losing what it may of what it has."""
    f = fx.forest(spark, sf_dir).select("cell", "receiver", F.explode(F.expr("sequence(0L, 11L)")).alias("month"))
    return routing.route_with_loss(f.withColumns({"lateral": F.col("cell") * (F.col("month") + 1) % 10, "loss": (F.col("cell") * 3 + F.col("month")) % 40}))


@query(
    "ocean_areas",
    ORACLES["connected_components"].replace("SELECT a AS node, min(b) AS label FROM reach GROUP BY 1", "")
    + "SELECT label, count(*) AS area FROM (SELECT a AS node, min(b) AS label FROM reach GROUP BY 1) GROUP BY 1 HAVING 1000 * count(*) >= (SELECT count(*) FROM m)",
)
def ocean_areas(spark, sf_dir):
    """Areas of the components of water that have a thousandth of it or more."""
    parts = connected_components(spark, sf_dir).groupBy("label").agg(F.count("*").alias("area"))
    return parts.join(F.broadcast(parts.agg(F.sum("area").alias("_all"))), F.col("area") * 1000 >= F.col("_all")).select("label", "area")


@query(
    "yield_density",
    f"""WITH RECURSIVE {fx.FOREST_SQL}, up AS (SELECT cell AS source, cell FROM f UNION ALL SELECT up.source, f.receiver FROM up JOIN f ON up.cell = f.cell WHERE f.receiver IS NOT NULL),
    t AS (SELECT up.cell, sum(f.value) AS total FROM up JOIN f ON f.cell = up.source GROUP BY 1), d AS (SELECT f.receiver AS cell, sum(total) AS donors FROM f JOIN t USING (cell) WHERE receiver IS NOT NULL GROUP BY 1)
    SELECT cell, (total - coalesce(donors, 0))::BIGINT AS own, round((total - coalesce(donors, 0))::DOUBLE / (1 + cell % 5), 6) AS density FROM t LEFT JOIN d USING (cell)""",
)
def yield_density(spark, sf_dir):
    """What each cell adds to the discharge of its donors, over its area."""
    f = graph.cut(fx.forest(spark, sf_dir))
    t = graph.cut(graph.accumulate(f))
    donors = f.filter("receiver IS NOT NULL").join(t, "cell").groupBy(F.col("receiver").alias("cell")).agg(F.sum("total").alias("_d"))
    own = F.col("total") - F.coalesce("_d", F.lit(0))
    return t.join(donors, "cell", "left").select("cell", own.alias("own"), F.round(own / (1 + F.col("cell") % 5), 6).alias("density"))


# ---- checks of fields ------------------------------------------------------------------------


@query(
    "relief_summary",
    f"""WITH {fx.GRID_SQL} SELECT r // 16 AS block, count(*) AS cells, round(quantile_cont(z, 0.1), 6) AS p10, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.9), 6) AS p90, round(stddev_pop(z), 6) AS deviation,
      round(avg(CASE WHEN z > 0 THEN 1 ELSE 0 END), 6) AS land, round(avg(CASE WHEN z > 2500 THEN 1 ELSE 0 END), 6) AS mountain, round(avg(CASE WHEN z BETWEEN 0 AND 200 THEN 1 ELSE 0 END), 6) AS plain, round(avg(CASE WHEN z > 0 THEN z::DOUBLE * z END), 3) AS land_square FROM g GROUP BY 1""",
)
def relief_summary(spark, sf_dir):
    z, part = F.col("z"), lambda p: F.avg(p.cast("int"))
    stats = {**{f"p{q}": F.percentile("z", q / 100) for q in (10, 50, 90)}, "deviation": F.stddev_pop("z"), "land": part(z > 0), "mountain": part(z > 2500), "plain": part(z.between(0, 200))}
    return fx.grid(spark, sf_dir).groupBy(F.expr("r div 16").alias("block")).agg(F.count("*").alias("cells"), *rounded(stats), F.round(F.avg(F.when(z > 0, z.cast("double") * z)), 3).alias("land_square"))


@query(
    "local_errors",
    f"""WITH {fx.GRID_SQL}, e AS (SELECT z, z + (cell * 37 % 101 - 50) AS y FROM g), k AS (SELECT * FROM e, (VALUES ('land', 0, 100000), ('low', 0, 20), ('coast', 0, 100)) m(mask, a, b) WHERE z >= a AND z < b)
    SELECT mask, count(*) AS pixels, round(avg(abs(y - z)), 6) AS mae, round(quantile_cont(abs(y - z), 0.99), 6) AS p99, round(avg(CASE WHEN (y < 0) <> (z < 0) THEN 1 ELSE 0 END), 6) AS flips FROM k GROUP BY 1""",
)
def local_errors(spark, sf_dir):
    """Errors of a candidate's heights under masks of the reference's; one pass, a row a mask."""
    e = fx.grid(spark, sf_dir).select("z", (F.col("z") + F.col("cell") * 37 % 101 - 50).alias("y"))
    masks = F.array(*(F.struct(F.lit(n).alias("mask"), F.lit(b).alias("b")) for n, b in (("land", 100000), ("low", 20), ("coast", 100))))
    k = e.filter("z >= 0").select("z", "y", F.explode(masks).alias("m")).filter("z < m.b")
    off = F.abs(F.col("y") - F.col("z"))
    return k.groupBy("m.mask").agg(F.count("*").alias("pixels"), *rounded({"mae": F.avg(off), "p99": F.percentile(off, 0.99), "flips": F.avg(((F.col("y") < 0) != (F.col("z") < 0)).cast("int"))}))


@query(
    "boundary_profile",
    f"""WITH {fx.GRID_SQL}, d AS (SELECT c % 8 AS phase, z - lag(z) OVER (PARTITION BY r ORDER BY c) AS s, z >= 0 AND lag(z) OVER (PARTITION BY r ORDER BY c) >= 0 AS land FROM g)
    SELECT phase, count(*) AS pairs, round(avg(s::DOUBLE * s), 4) AS square FROM d WHERE land GROUP BY 1""",
)
def boundary_profile(spark, sf_dir):
    """Mean squared steps along rows by the column's place in a tile, land only."""
    before = F.lag("z").over(Window.partitionBy("r").orderBy("c"))
    d = fx.grid(spark, sf_dir).select((F.col("c") % 8).alias("phase"), "z", before.alias("b")).filter("z >= 0 AND b >= 0")
    step = (F.col("z") - F.col("b")).cast("double")
    return d.groupBy("phase").agg(F.count("*").alias("pairs"), F.round(F.avg(step * step), 4).alias("square"))


@query(
    "audit_ratios",
    """WITH a AS (SELECT p_brand AS brand, p_size % 3 AS kind, median(p_retailprice) AS m FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2), b AS (SELECT * FROM a WHERE kind = 0), c AS (SELECT * FROM a WHERE kind = 1 AND brand <> 'Brand#11')
    SELECT coalesce(b.brand, c.brand) AS brand, round(c.m / b.m, 6) AS ratio, CASE WHEN b.m IS NULL OR c.m IS NULL THEN 'missing' WHEN c.m / b.m BETWEEN 0.95 AND 1.05 THEN 'pass' ELSE 'fail' END AS gate FROM b FULL JOIN c ON b.brand = c.brand""",
)
def audit_ratios(spark, sf_dir):
    """Medians of a candidate beside those of a baseline, case by case; a case that either lacks is named."""
    a = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").groupBy(F.col("p_brand").alias("brand"), (F.col("p_size") % 3).alias("kind")).agg(F.median("p_retailprice").alias("m"))
    b, c = a.filter("kind = 0").select("brand", F.col("m").alias("b")), a.filter("kind = 1 AND brand <> 'Brand#11'").select("brand", F.col("m").alias("c"))
    ratio = F.col("c") / F.col("b")
    gate = F.when(ratio.isNull(), "missing").when(ratio.between(0.95, 1.05), "pass").otherwise("fail")
    return b.join(c, "brand", "full").select("brand", F.round(ratio, 6).alias("ratio"), gate.alias("gate"))
