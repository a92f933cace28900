"""From cells to their children: bilinear values, envelopes and integer budgets, all exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.apportion import apportion
from quillgrid.operators.spatial import neighbours


def around(grid: DataFrame, values: list[str]) -> DataFrame:
    """``grid`` with ``_near``: the values of up to eight neighbours by direction. One
    explode of eight and one sum by place; a place never gathers more than eight."""
    offers = neighbours(grid, "r", "c", values)
    near = offers.groupBy(F.col("_r").alias("r"), F.col("_c").alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("dir", F.struct(*values)))).alias("_near"))
    return grid.join(near, ["r", "c"], "left")


def children(grid: DataFrame, n: int, values: list[str]) -> DataFrame:
    """The n x n children (a, b) of each cell, with each of ``values`` bilinear between the
    centres of cells and multiplied by 4 n^2, so that integers stay exact. Neighbours that
    are not there count as the cell itself."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_k")
    fine = around(grid, values).select("*", k).withColumns({"a": F.expr(f"_k div {n}").cast("long"), "b": (F.col("_k") % n).cast("long")})
    south, east = 2 * F.col("a") + 1 - n, 2 * F.col("b") + 1 - n
    v = F.when(south < 0, 0).otherwise(4)
    h = F.when(east < 0, 6).otherwise(2)
    # the diagonal lies between its two sides, and before north on the west
    d = F.when((south < 0) & (east < 0), 7).when(south < 0, 1).when(east < 0, 5).otherwise(3)

    def one(name: str) -> Column:
        other = lambda way: F.coalesce(F.try_element_at("_near", way)[name], F.col(name))
        s, e = F.abs(south), F.abs(east)
        return (2 * n - s) * (2 * n - e) * F.col(name) + s * (2 * n - e) * other(v) + (2 * n - s) * e * other(h) + s * e * other(d)

    return fine.withColumns({f"_f_{x}": one(x) for x in values}).drop("_near", "_k", *values).withColumnsRenamed({f"_f_{x}": x for x in values})


def descend(grid: DataFrame, n: int) -> DataFrame:
    """(cell, a, b, share): each cell's integer ``total`` split over its n x n children by the
    bilinear integer ``weight`` at their centres; sums of children are the cell's total, and
    depend on nothing but the cell and its neighbours."""
    fine = children(grid, n, ["weight"]).withColumn("_child", F.col("a") * n + F.col("b"))
    return apportion(fine, "cell", "_child", "weight", "total").select("cell", "a", "b", "share")


def envelope(grid: DataFrame, n: int, margin: float) -> DataFrame:
    """(cell, a, b, low, high): the least and greatest ``z`` of a cell and its neighbours,
    bilinear at its n x n children, less and more ``margin``."""
    offers = neighbours(grid, "r", "c", ["z"]).select(F.col("_r").alias("r"), F.col("_c").alias("c"), F.col("z").alias("_z"))
    near = offers.groupBy("r", "c").agg(F.min("_z").alias("_low"), F.max("_z").alias("_high"))
    bounds = grid.join(near, ["r", "c"], "left").select("cell", "r", "c", F.least("z", "_low").alias("low"), F.greatest("z", "_high").alias("high"))
    fine = children(bounds, n, ["low", "high"])
    return fine.select("cell", "a", "b", (F.col("low") / (4 * n * n) - margin).alias("low"), (F.col("high") / (4 * n * n) + margin).alias("high"))
