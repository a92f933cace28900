"""Further queries: sequences, stocks, identities, comparisons, sampling policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.operators import lines
from quillgrid.operators import statistics as st
from quillgrid.plans import fixtures as fx
from quillgrid.plans.catalogue import SAMPLES_SQL, query, samples
from quillgrid.sources.tables import table

EVENTS_SQL = f"{fx.REQUESTS_SQL}, n AS (SELECT session, event_id, key, event_id * 37 % 360 AS x, event_id * 53 % 101 AS y FROM q)"


def steps(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("session", "event_id", "key", (F.col("event_id") * 37 % 360).alias("x"), (F.col("event_id") * 53 % 101).alias("y"))


@query(
    "moving_average",
    f"""WITH {EVENTS_SQL}, a AS (SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY session) AS c, first_value(key) OVER (PARTITION BY session ORDER BY event_id) AS f,
      first_value(key) OVER (PARTITION BY session ORDER BY event_id DESC) AS l, sum(key) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM n WINDOW o AS (PARTITION BY session ORDER BY event_id))
    SELECT session, event_id, round((s + greatest(0, 3 - pos) * f + greatest(0, pos + 2 - c) * l)::DOUBLE / 5, 6) AS mean FROM a""",
)
def moving_average(spark, sf_dir):
    return lines.moving_average(steps(spark, sf_dir), "session", "event_id", "key", 5).select("session", "event_id", F.round("mean", 6).alias("mean"))


@query(
    "longitude_unwrap",
    f"""WITH {EVENTS_SQL}, a AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY session ORDER BY event_id), 0) AS d FROM n)
    SELECT session, event_id, (x - 360 * sum(CAST(floor((d + 180) / 360.0) AS BIGINT)) OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS unwrapped FROM a""",
)
def longitude_unwrap(spark, sf_dir):
    return lines.unwrap(steps(spark, sf_dir), "session", "event_id", "x", 360).select("session", "event_id", F.col("unwrapped").cast("long").alias("unwrapped"))


@query(
    "cumulative_length",
    f"""WITH {EVENTS_SQL}, a AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy FROM n WINDOW o AS (PARTITION BY session ORDER BY event_id))
    SELECT session, round(sum(sqrt((dx * dx + dy * dy)::DOUBLE)), 4) AS length, count(*) AS points FROM a GROUP BY 1""",
)
def cumulative_length(spark, sf_dir):
    o = Window.partitionBy("session").orderBy("event_id")
    dx, dy = F.col("x") - F.lag("x").over(o), F.col("y") - F.lag("y").over(o)
    return steps(spark, sf_dir).withColumn("d", F.sqrt((dx * dx + dy * dy).cast("double"))).groupBy("session").agg(F.round(F.sum("d"), 4).alias("length"), F.count("*").alias("points"))


@query("monotone_profile")
def monotone_profile(spark, sf_dir):
    """Non-increasing least-squares fit of each session's values (a kernel: sequential)."""
    return lines.monotone_fit(steps(spark, sf_dir).select("session", "event_id", F.col("key").cast("double").alias("level")), "session", "event_id", "level")


@query("simplified_lines")
def simplified_lines(spark, sf_dir):
    """Vertices kept within 20 units of each session's line (a kernel: recursive)."""
    return lines.simplify(steps(spark, sf_dir), "session", "event_id", "x", "y", 20.0)


YEARS = 6


@query(
    "forest_stock",
    "WITH s0 AS (SELECT c_custkey AS cell, (c_custkey % 90 + 10)::DOUBLE AS stock FROM customer), "
    + ", ".join(f"s{k + 1} AS (SELECT cell, greatest(0.0, stock + 0.25::DOUBLE * stock * (1 - stock / 100) - (cell * {k + 1} % 7)) AS stock FROM s{k})" for k in range(YEARS))
    + f" SELECT cell, round(stock, 6)::DOUBLE AS stock FROM s{YEARS}",
)
def forest_stock(spark, sf_dir):
    """Logistic regrowth less removals, never below zero, folded over the years."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 90 + 10).cast("double").alias("s"))
    grow = lambda s, k: F.greatest(F.lit(0.0), s + F.lit(0.25) * s * (1 - s / 100) - (F.col("cell") * k % 7))
    return df.select("cell", F.round(F.aggregate(F.sequence(F.lit(1), F.lit(YEARS)), F.col("s"), grow), 6).alias("stock"))


@query(
    "deposit_depletion",
    """WITH a AS (SELECT l_partkey AS deposit, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS taken FROM lineitem),
    b AS (SELECT *, sum(taken) OVER (PARTITION BY deposit ORDER BY l_orderkey, l_linenumber, taken ROWS UNBOUNDED PRECEDING) AS gone FROM a)
    SELECT deposit, l_orderkey, l_linenumber, greatest(0, p_size * 20 - gone)::BIGINT AS left_t, round(3.0::DOUBLE * pow(1 + least(gone, p_size * 20)::DOUBLE / (p_size * 20), 2), 6) AS cost FROM b JOIN part ON deposit = p_partkey""",
)
def deposit_depletion(spark, sf_dir):
    """What is left after each extraction, and its cost base (1 + used)^2."""
    w = Window.partitionBy("deposit").orderBy("l_orderkey", "l_linenumber", "taken").rowsBetween(Window.unboundedPreceding, 0)
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("deposit"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("taken")).withColumn("gone", F.sum("taken").over(w))
    df = df.join(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("all")), F.col("deposit") == F.col("p_partkey"))
    used = F.least("gone", "all").cast("double") / F.col("all")
    return df.select("deposit", "l_orderkey", "l_linenumber", F.greatest(F.lit(0), F.col("all") - F.col("gone")).cast("long").alias("left_t"), F.round(3.0 * F.pow(1 + used, F.lit(2.0)), 6).alias("cost"))


@query("seed_from_text", "SELECT s_suppkey AS id, (CAST('0x' || h[5:6] || h[3:4] || h[1:2] AS BIGINT)) AS seed FROM (SELECT s_suppkey, sha256(s_name) AS h FROM supplier)")
def seed_from_text(spark, sf_dir):
    """The first three bytes of a text's SHA-256, little-endian."""
    h = F.sha2("s_name", 256)
    swapped = F.concat(F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.conv(swapped, 16, 10).cast("long").alias("seed"))


@query("canonical_identity", """SELECT n_nationkey AS id, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS identity FROM nation""")
def canonical_identity(spark, sf_dir):
    """SHA-256 of the compact JSON with sorted keys."""
    record = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.sha2(F.to_json(record), 256).alias("identity"))


@query("lattice_phase_sums", f"WITH {fx.GRID_SQL} SELECT r % 8 AS pr, c % 8 AS pc, sum(z)::BIGINT AS total, count(*) AS n FROM g GROUP BY 1, 2")
def lattice_phase_sums(spark, sf_dir):
    return fx.grid(spark, sf_dir).groupBy((F.col("r") % 8).alias("pr"), (F.col("c") % 8).alias("pc")).agg(F.sum("z").alias("total"), F.count("*").alias("n"))


@query(
    "array_summary",
    f"WITH {fx.GRID_SQL} SELECT r // 32 AS block, min(z) AS low, quantile_cont(z, 0.05) AS p05, quantile_cont(z, 0.5) AS median, quantile_cont(z, 0.95) AS p95, max(z) AS high, round(avg(z), 6) AS mean FROM g GROUP BY 1",
)
def array_summary(spark, sf_dir):
    p = F.percentile("z", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    df = fx.grid(spark, sf_dir).groupBy(F.expr("r div 32").alias("block")).agg(F.min("z").alias("low"), p.alias("p"), F.max("z").alias("high"), F.round(F.avg("z"), 6).alias("mean"))
    return df.select("block", "low", *(F.round(F.col("p")[k], 9).alias(n) for k, n in enumerate(("p05", "median", "p95"))), "high", "mean")


@query(
    "statistics_compare",
    """WITH a AS (SELECT l_shipdate < TIMESTAMP '1996-01-01' AS early, l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT coalesce(x.flag, y.flag) AS flag, coalesce(x.status, y.status) AS status, coalesce(x.n, 0) AS reference, coalesce(y.n, 0) AS current,
      abs(coalesce(y.n, 0) - coalesce(x.n, 0)) * 10 <= coalesce(x.n, 0) AS within FROM (FROM a WHERE early) x FULL JOIN (FROM a WHERE NOT early) y ON x.flag = y.flag AND x.status = y.status""",
)
def statistics_compare(spark, sf_dir):
    """Counts of two periods side by side, with a bound of a tenth."""
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")
    a = table(spark, sf_dir, "lineitem").select(early.alias("early"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).groupBy("flag", "status").agg(
        F.count_if("early").alias("reference"), F.count_if(~F.col("early")).alias("current")
    )
    return a.withColumn("within", F.abs(F.col("current") - F.col("reference")) * 10 <= F.col("reference"))


@query(
    "stratified_policy",
    f"""WITH {SAMPLES_SQL}, k AS (SELECT kind, count(*) AS n FROM s GROUP BY 1)
    SELECT doc_id, kind, round(0.75::DOUBLE / (SELECT count(*) FROM s) + 0.25::DOUBLE / ((SELECT count(*) FROM k) * n), 12) AS probability FROM s JOIN k USING (kind)""",
)
def stratified_policy(spark, sf_dir):
    """Probability of each sample: most of it even, a quarter shared by kind. The few
    kinds are counted first and joined back; no window over all rows."""
    s = samples(spark, sf_dir).select("doc_id", "kind")
    kinds = s.groupBy("kind").agg(F.count("*").alias("n"))
    whole = kinds.agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).first()
    p = F.lit(0.75) / (whole["all"] or 1) + F.lit(0.25) / (F.col("n") * (whole["kinds"] or 1))
    return s.join(kinds, "kind").select("doc_id", "kind", F.round(p, 12).alias("probability"))


@query(
    "queue_backpressure",
    f"""WITH {fx.REQUESTS_SQL}, a AS (SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM q)
    SELECT event_id, row_number() OVER (PARTITION BY b ORDER BY event_id) > 64 AS rejected FROM a""",
)
def queue_backpressure(spark, sf_dir):
    """Of each six hours the first 64 requests are taken, the others refused."""
    r = fx.requests(spark, sf_dir).select("event_id", F.window("ts", "6 hours").alias("b"))
    return r.select("event_id", (F.row_number().over(Window.partitionBy("b").orderBy("event_id")) > 64).alias("rejected"))


@query(
    "priority_near_camera_all",
    f"""WITH {fx.GRID_SQL}, w AS (SELECT r // 8 AS wi, c // 8 AS wj, max(z) < 3000 AS sea FROM g GROUP BY 1, 2)
    SELECT wi, wj, row_number() OVER (ORDER BY sea, NOT (abs(wi - 10) <= 3 AND abs(wj - 4) <= 3), (wi - 10) * (wi - 10) + (wj - 4) * (wj - 4), wi, wj)::INTEGER AS rank FROM w""",
)
def priority_near_camera_all(spark, sf_dir):
    """Every window's rank: land, then visible, then near. Two-level running counts; no
    task holds all windows."""
    w = fx.grid(spark, sf_dir).groupBy(F.expr("r div 8").alias("wi"), F.expr("c div 8").alias("wj")).agg((F.max("z") < 3000).alias("sea"))
    di, dj = F.col("wi") - 10, F.col("wj") - 4
    w = w.withColumns({"hidden": ~((F.abs(di) <= 3) & (F.abs(dj) <= 3)), "d2": di * di + dj * dj, "all": F.lit(0), "one": F.lit(1)})
    ranked = st.running_totals(w, "all", [F.col(x) for x in ("sea", "hidden", "d2", "wi", "wj")], "one")
    return ranked.select("wi", "wj", (F.col("_before") + 1).cast("int").alias("rank"))
