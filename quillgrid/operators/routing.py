"""Routing that is not additive: monthly volumes with losses on the way, orders of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.contraction import settle
from quillgrid.session import apart, written


def strahler(nodes: DataFrame) -> DataFrame:
    """(cell, order): the greatest order of the donors, one more if two or more have it;
    1 without donors. As many rounds as the highest order."""
    return settle(nodes.select("cell", "receiver")).select("cell", F.col("order").cast("long").alias("order"))


def route_with_loss(nodes: DataFrame) -> DataFrame:
    """(cell, month, inflow, loss, outflow) of (cell, receiver, month, lateral, loss), neither of them
    negative: a cell loses what it may of its inflow and own water, never more than there is;
    the rest goes to its receiver. The months of a cell (the few values of ``month``) are settled beside each other."""
    months = sorted(r[0] for r in nodes.select("month").distinct().collect())
    if not months:
        return nodes.select("cell", "month", F.col("lateral").alias("inflow"), "loss", F.col("lateral").alias("outflow"))
    kind = nodes.schema["lateral"].dataType
    of = lambda m, x: F.when(F.col("month") == m, x)
    sums = [f for k, m in enumerate(months) for f in (F.sum(of(m, F.col("lateral") - F.col("loss"))).alias(f"m{k}"), F.max(of(m, F.struct("lateral"))).alias(f"l{k}"))]
    wide = written(nodes.groupBy("cell").agg(F.max("receiver").alias("receiver"), *sums))
    # a cell without a month passes on what it gets
    adds = [F.coalesce(f"m{k}", F.lit(0)).cast(kind).alias(f"m{k}") for k in range(len(months))]
    settled = settle(wide.select("cell", "receiver", *adds), [f"m{k}" for k in range(len(months))])
    both = settled.join(apart(wide.select("cell", *(f"l{k}" for k in range(len(months))))), "cell")
    each = F.array(*(F.struct(F.lit(m).alias("month"), F.col(f"m{k}_in").alias("inflow"), F.col(f"m{k}_out").alias("outflow"), F.col(f"l{k}").alias("own")) for k, m in enumerate(months)))
    tall = both.select("cell", F.explode(F.filter(each, lambda x: x["own"].isNotNull())).alias("_x")).select("cell", "_x.*")
    return tall.select("cell", "month", "inflow", (F.col("inflow") + F.col("own.lateral") - F.col("outflow")).alias("loss"), "outflow")
