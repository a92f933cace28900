"""Grids, forests and logs derived from the tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.tables import table

GRID_SQL = "g AS (SELECT o_orderkey AS cell, o_orderkey // 64 AS r, o_orderkey % 64 AS c, CAST(floor(o_totalprice) AS BIGINT) % 5000 - 1000 AS z FROM orders)"
FOREST_SQL = "f AS (SELECT o_orderkey AS cell, CASE WHEN o_orderkey > 0 THEN o_orderkey // 3 END AS receiver, CAST(floor(o_totalprice) AS BIGINT) % 100 AS value FROM orders)"
DIRECTIONS_SQL = "dirs(k, dr, dc) AS (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1))"
DRAINAGE_SQL = f"""{GRID_SQL}, {DIRECTIONS_SQL},
    d AS (SELECT g.cell, arg_max(n.cell, (g.z - n.z) * (g.z - n.z) * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END * 8 - k) AS receiver
          FROM g JOIN dirs ON true JOIN g n ON n.r = g.r + dr AND n.c = g.c + dc WHERE n.z < g.z GROUP BY g.cell),
    drain AS (SELECT g.cell, d.receiver FROM g LEFT JOIN d USING (cell))"""
REQUESTS_SQL = "q AS (SELECT event_id, user_id AS session, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, event_type AS kind, value FROM events)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, r, c, z): 64 columns wide, integer metres."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell"), F.expr("o_orderkey div 64").alias("r"), (F.col("o_orderkey") % 64).alias("c"),
        (F.floor("o_totalprice").cast("long") % 5000 - 1000).alias("z"),
    )


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, receiver, value): receiver = cell div 3."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell"), F.expr("IF(o_orderkey > 0, o_orderkey div 3, NULL)").alias("receiver"), (F.floor("o_totalprice").cast("long") % 100).alias("value")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session, ts, key, kind, value)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session"), "ts", F.get_json_object("props", "$.k").cast("long").alias("key"), F.col("event_type").alias("kind"), "value"
    )


def draw_sql(source: str, cell: str, prefix: int) -> str:
    """CTEs d0..d3 over ``source``: d3 has column ``k``, the key of each row's ``cell``."""
    m = "18446744073709551616"
    step = lambda x, s, c: f"((xor({x}, {x} >> {s})::UHUGEINT * {c}::UHUGEINT) % {m}::UHUGEINT)::UBIGINT"
    return f"""d0 AS (SELECT *, ((xor({cell}::UBIGINT, {prefix}::UBIGINT)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % {m}::UHUGEINT)::UBIGINT AS z0 FROM {source}),
    d1 AS (SELECT *, {step('z0', 30, 0xBF58476D1CE4E5B9)} AS z1 FROM d0),
    d2 AS (SELECT *, {step('z1', 27, 0x94D049BB133111EB)} AS z2 FROM d1),
    d3 AS (SELECT *, xor(z2, z2 >> 31) AS k FROM d2)"""
