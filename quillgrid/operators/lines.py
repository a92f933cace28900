"""Ordered sequences: moving means, lengths, unwrapped angles, monotone fits, simplified lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, group: str, order: str, value: str, size: int) -> DataFrame:
    """Centred mean of an odd window; beyond the ends the end values repeat."""
    half = size // 2
    w = Window.partitionBy(group)
    o = w.orderBy(order)
    near = o.rowsBetween(-half, half)
    at, n = F.row_number().over(o), F.count("*").over(w)
    first, last = F.first(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before, after = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), at + half - n)
    return df.withColumn("mean", (F.sum(value).over(near) + before * first + after * last) / size)


def unwrap(df: DataFrame, group: str, order: str, value: str, period: int) -> DataFrame:
    """Adds whole periods so that each step is the shortest one (a half period counts as back)."""
    o = Window.partitionBy(group).orderBy(order)
    step = F.coalesce(F.col(value) - F.lag(value).over(o), F.lit(0))
    turns = -F.floor((step + period / 2) / period)
    return df.withColumn("_turns", turns).withColumn("unwrapped", F.col(value) + period * F.sum("_turns").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_turns")


def non_increasing(values: np.ndarray) -> np.ndarray:
    """Least-squares non-increasing fit: neighbouring blocks that rise are pooled."""
    sums: list[float] = []
    sizes: list[int] = []
    for v in values:
        sums.append(float(v))
        sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] < sums[-1] * sizes[-2]:
            total, count = sums.pop(), sizes.pop()
            sums[-1] += total
            sizes[-1] += count
    return np.repeat([s / n for s, n in zip(sums, sizes, strict=True)], sizes)


def monotone_fit(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """One group (a reach) at a time; the fit is sequential, so it is a kernel."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows.assign(fitted=non_increasing(rows[value].to_numpy()))

    return df.select(group, order, value).groupBy(group).applyInPandas(fit, df.select(group, order, value, F.lit(0.0).alias("fitted")).schema)


def simplified(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Places kept by halving at the farthest point beyond the tolerance; ends stay."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(xy) - 1)]
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        d, p = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        t = np.clip(p @ d / max(float(d @ d), 1e-12), 0, 1)
        far = np.hypot(*(p - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            open_spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(df: DataFrame, group: str, order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """The kept vertices of each group's line."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        return rows[simplified(rows[[x, y]].to_numpy(float), tolerance)] if len(rows) > 1 else rows

    return df.select(group, order, x, y).groupBy(group).applyInPandas(cut, df.select(group, order, x, y).schema)
