"""Exact integer budgets: largest remainder, clearing prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.keys import unsigned_order


def apportion(children: DataFrame, parent: str, child: str, weight: str, total: str) -> DataFrame:
    """Splits each parent's integer ``total`` by its children's integer weights: floor
    shares, then one seat each to the largest remainders, ties to the lower unsigned
    id. A parent whose weights are all zero is split evenly. One shuffle by parent."""
    w = Window.partitionBy(parent)
    df = children.withColumn("_sum0", F.sum(weight).over(w))
    df = df.withColumn("_w", F.when(F.col("_sum0") == 0, F.lit(1)).otherwise(F.col(weight)).cast("long")).withColumn("_s", F.sum("_w").over(w))
    df = df.withColumns({"_floor": F.expr(f"({total} * _w) div _s"), "_rest": F.col(total) * F.col("_w") % F.col("_s")})
    df = df.withColumn("_left", F.col(total) - F.sum("_floor").over(w))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.col("_rest").desc(), unsigned_order(F.col(child))))
    return df.withColumn("share", F.col("_floor") + F.when((rank <= F.col("_left")) & (F.col("_rest") > 0), 1).otherwise(0)).drop(
        "_sum0", "_w", "_s", "_floor", "_rest", "_left"
    )


def clearing_prefix(cells: DataFrame, parent: str, child: str, area: str, score: Column, cleared: Column) -> DataFrame:
    """The share of each cell cleared when its parent has ``cleared`` area cleared, best
    score first (ties: lower unsigned id): a prefix, so it only grows with the area."""
    order = Window.partitionBy(parent).orderBy(F.col("_score").desc(), unsigned_order(F.col(child)))
    before = F.coalesce(F.sum(area).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = cells.withColumn("_score", score).withColumn("_before", before).withColumn("_cleared", cleared)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_cleared") - F.col("_before")) / F.greatest(F.col(area).cast("double"), F.lit(1e-12))))
    return df.withColumn("fraction", share).drop("_score", "_before", "_cleared")
