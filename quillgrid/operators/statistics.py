"""Weighted quantiles, hypsometry, top shares, block means, window fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators.graph import cut


def running_totals(df: DataFrame, group: str, order: list, value: str) -> DataFrame:
    """Adds ``_before``, the sum of ``value`` over the rows of the group that come
    earlier in ``order``, and ``_all``, the group's sum.

    Two levels, so that a group may be larger than a task: rows are dealt by range
    and written; sums of each (group, range) are few and tell where a range begins;
    within it a window does the rest. ``order`` must tell all rows of a group apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p0")).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy("_g")
    offsets = sums.withColumns({
        "_offset": F.coalesce(F.sum("_sum").over(w.orderBy("_p0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_sum").over(w),
    }).drop("_sum")
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(offsets, dealt[group].eqNullSafe(offsets["_g"]) & (dealt["_part"] == offsets["_p0"]))
    return joined.withColumn("_before", F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset", "_g", "_p0", "_part")


def weighted_quantiles(df: DataFrame, group: str, value: str, weight: str, tie: str, probabilities: list[float]) -> DataFrame:
    """Quantiles by the midpoint rule: a row stands at (weights up to it - half its
    own) / all weights, with linear interpolation between and the ends held.

    The rows next to each probability are found by one aggregation, summed up before
    its shuffle: the last at or under it and the first above it.
    """
    rows = df.select(group, tie, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    curve = running_totals(rows, group, [F.col("_v"), F.col(tie)], "_w")
    at = F.struct(((F.col("_before") + F.col("_w") / 2) / F.col("_all")).alias("p"), F.col(tie).alias("tie"), F.col("_v").alias("v"))
    curve = curve.select(group, at.alias("_at"))
    ends = []
    for k, p in enumerate(probabilities):
        ends += [F.max(F.when(F.col("_at.p") <= p, F.col("_at"))).alias(f"_lo{k}"), F.min(F.when(F.col("_at.p") > p, F.col("_at"))).alias(f"_hi{k}")]
    found = curve.groupBy(group).agg(*ends)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"_lo{k}").alias("lo"), F.col(f"_hi{k}").alias("hi")) for k, p in enumerate(probabilities)))).alias("q")
    q = found.select(group, each).select(group, "q.p", "q.lo", "q.hi")
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col("p") - F.col("lo.p")) / (F.col("hi.p") - F.col("lo.p"))
    return q.select(group, "p", F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).otherwise(between).alias("quantile"))


def top_share(df: DataFrame, group: str, score: str, area: str, mass: str, fractions: list[float], tie: str) -> DataFrame:
    """Share of each group's mass in the best ``fractions`` of its area, the last cell in part."""
    df = running_totals(df.select(group, score, area, mass, tie), group, [F.col(score).desc(), F.col(tie)], area)
    part = lambda f: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(f) * F.col("_all") - F.col("_before")) / F.col(area)))
    sums = df.groupBy(group).agg(F.sum(mass).alias("_mass"), *(F.sum(part(f) * F.col(mass)).alias(f"_s{k}") for k, f in enumerate(fractions)))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), F.col(f"_s{k}").alias("s")) for k, f in enumerate(fractions)))).alias("q")
    return sums.select(group, "_mass", each).select(group, "q.fraction", (F.col("q.s") / F.col("_mass")).alias("share"))


def histogram(df: DataFrame, value: str, weight: str, edges: list[int]) -> DataFrame:
    """Weights by bin: the number of edges at or under the value."""
    bins = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col(value)))
    return df.groupBy(bins.cast("long").alias("bin")).agg(F.sum(weight).cast("long").alias("weight"))


def block_mean(grid: DataFrame, row: str, col: str, value: str, factor: int) -> DataFrame:
    """Means of complete blocks only: sums and counts, so blocks are summed before the shuffle."""
    return (
        grid.groupBy(F.expr(f"{row} div {factor}").alias("block_row"), F.expr(f"{col} div {factor}").alias("block_col"))
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_n")).filter(F.col("_n") == factor * factor)
        .select("block_row", "block_col", (F.col("_s") / F.col("_n")).alias("mean"))
    )


def window_fusion(grid: DataFrame, row: str, col: str, value: str, size: int, stride: int, seen: Column | None = None) -> DataFrame:
    """Overlapping windows of ``size`` cells at every ``stride``, triangular integer
    weights; each cell becomes sum(w v) / sum(w). Windows of a cell are made by a
    bounded explode (size / stride in each direction). ``seen`` is what a window makes of
    its cell's value, given the window's numbers ``_wi`` and ``_wj``: the value itself unless given."""
    def starts(x: str) -> str:
        return f"filter(transform(sequence(0, {size // stride - 1}), k -> ({x} div {stride} - k)), s -> s >= 0)"

    weight = lambda x, s: f"least({x} - {s} * {stride} + 1, {size} - ({x} - {s} * {stride}))"
    rows = grid.withColumn("_wi", F.explode(F.expr(starts(row)))).withColumn("_wj", F.explode(F.expr(starts(col))))
    rows = rows.select(row, col, (F.col(value) if seen is None else seen).alias("_v"), F.expr(f"{weight(row, '_wi')} * {weight(col, '_wj')}").alias("_w"))
    return rows.groupBy(row, col).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("fused"))
