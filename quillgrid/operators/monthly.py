"""Water stores of a cell through the months of a year, in series.

Three stores feed each other and nothing feeds back: a snow pack (degree days), a soil
(filled by water beyond demand, dried by the exponential law of Thornthwaite and
Mather) and a linear groundwater reservoir. Each is one scan over an array of monthly
inputs that gives an array of monthly outputs, which are the inputs of the next.

As no store depends on a later one, a periodic year is found store by store, from
each one's annual map (its level after a year as a function of the level before):
the pack's is settled after two years or grows to its cap, the soil's only ever rises
with its argument and is solved by halving, the reservoir's is linear.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.hydrology import MONTH_DAYS


@dataclass(frozen=True)
class Stores:
    """Capacities (mm), melt (mm a degree and day), the share of surplus that seeps, and the reservoir's time (days)."""

    snow_cap: float = 1000.0
    soil_cap: float = 150.0
    degree_day: float = 3.0
    seepage: float = 0.3
    gw_days: float = 90.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def scan(start: Column, inputs: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """(level, out): the level after all ``inputs``, and the output of each."""

    def month(s: Column, x: Column) -> Column:
        level, out = step(s["level"], x)
        return F.struct(level.alias("level"), F.array_append(s["out"], out).alias("out"))

    return F.aggregate(inputs, F.struct(start.cast("double").alias("level"), F.array().cast("array<double>").alias("out")), month)


def pack(start: Column, temp: Column, precipitation: Column, days: Column, p: Stores) -> Column:
    """Snow; its output is all water that reaches the soil: rain, melt and what the cap sheds."""
    inputs = F.arrays_zip(temp.alias("t"), precipitation.alias("p"), days.alias("d"))

    def step(level: Column, x: Column) -> tuple[Column, Column]:
        frozen = x["t"] <= 0
        held = level + F.when(frozen, x["p"]).otherwise(F.lit(0.0))
        left = F.least(F.greatest(held - p.degree_day * F.greatest(x["t"], F.lit(0.0)) * x["d"], F.lit(0.0)), F.lit(p.snow_cap))
        return left, F.when(frozen, F.lit(0.0)).otherwise(x["p"]) + held - left

    return scan(start, inputs, step)


def soil(start: Column, water: Column, demand: Column, p: Stores) -> Column:
    """Soil moisture; its output is the surplus over the capacity."""

    def step(level: Column, x: Column) -> tuple[Column, Column]:
        short = x["e"] - x["w"]
        moist = F.when(short > 0, level * F.exp(-short / p.soil_cap)).otherwise(level - short)
        kept = F.least(moist, F.lit(p.soil_cap))
        return kept, moist - kept

    return scan(start, F.arrays_zip(water.alias("w"), demand.alias("e")), step)


def reservoir(start: Column, recharge: Column, days: Column, p: Stores) -> Column:
    """Groundwater; its output is the flow that a linear reservoir gives in the month."""

    def step(level: Column, x: Column) -> tuple[Column, Column]:
        held = level + x["r"]
        flow = held * -F.expm1(-x["d"] / p.gw_days)
        return held - flow, flow

    return scan(start, F.arrays_zip(recharge.alias("r"), days.alias("d")), step)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def month_days() -> Column:
    return F.array(*(F.lit(float(d)) for d in MONTH_DAYS))


def water_year(temp: Column, rain: Column, pet: Column, years: int, stores: Stores = Stores()) -> Column:
    """snow, soil, gw after ``years`` of the same twelve months from empty stores, and
    the last year's aet and runoff. ``temp``, ``rain`` (rain and snow together) and
    ``pet`` are arrays of twelve."""
    again = lambda x: F.flatten(F.array_repeat(x, years))
    days, last, zero = again(month_days()), lambda x: total(F.slice(x, -12, 12)), F.lit(0.0)

    def from_soil(snow: Column, ground: Column, water_last: Column) -> Column:
        def from_gw(gw: Column) -> Column:
            surplus = last(ground["out"])
            before = ground["before"]
            return F.struct(
                snow["level"].alias("snow"), ground["level"].alias("soil"), gw["level"].alias("gw"),
                (water_last + before - ground["level"] - surplus).alias("aet"), (surplus * (1 - stores.seepage) + last(gw["out"])).alias("runoff"),
            )

        return once(reservoir(zero, F.transform(ground["out"], lambda x: x * stores.seepage), days, stores), from_gw)

    def from_snow(snow: Column) -> Column:
        # the soil up to the last year, and then that year
        early = F.slice(snow["out"], 1, 12 * (years - 1)) if years > 1 else F.array().cast("array<double>")
        first = soil(zero, early, F.slice(again(pet), 1, 12 * (years - 1)) if years > 1 else F.array().cast("array<double>"), stores)

        def join(a: Column) -> Column:
            end = soil(a["level"], F.slice(snow["out"], -12, 12), pet, stores)
            whole = once(end, lambda b: F.struct(b["level"].alias("level"), F.concat(a["out"], b["out"]).alias("out"), a["level"].alias("before")))
            return once(whole, lambda ground: from_soil(snow, ground, last(snow["out"])))

        return once(first, join)

    return once(pack(zero, again(temp), again(rain), days, stores), from_snow)


def settled_year(temp: np.ndarray, rain: np.ndarray, pet: np.ndarray, p: Stores, halvings: int) -> dict[str, np.ndarray]:
    """``periodic_year`` of arrays of (month, cell)."""
    days = np.array(MONTH_DAYS, float)[:, None]
    frozen, melt = temp <= 0, p.degree_day * np.maximum(temp, 0.0) * days
    falls, wets = np.where(frozen, rain, 0.0), np.where(frozen, 0.0, rain)

    def snow_year(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty_like(rain)
        for m in range(12):
            held = level + falls[m]
            level = np.minimum(np.maximum(held - melt[m], 0.0), p.snow_cap)
            out[m] = wets[m] + held - level
        return level, out

    a, _ = snow_year(np.zeros(rain.shape[1]))
    b, _ = snow_year(a)
    # what the pack begins the year with: it melts away at some time, or grows to its cap
    snow0 = np.where(b > a, snow_year(np.full(len(a), p.snow_cap))[0], b)
    snow, water = snow_year(snow0)
    short = pet - water
    dries, kept = short > 0, np.exp(-np.maximum(short, 0.0) / p.soil_cap)

    def soil_year(level: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        for m in range(12):
            moist = np.where(dries[m], level * kept[m], level - short[m])
            level = np.minimum(moist, p.soil_cap)
            if out is not None:
                out[m] = moist - level
        return level

    # the least level that a year does not raise
    low, high = np.zeros(len(a)), np.full(len(a), p.soil_cap)
    for _ in range(halvings):
        middle = (low + high) / 2
        rises = soil_year(middle) > middle
        low, high = np.where(rises, middle, low), np.where(rises, high, middle)
    soil0 = np.where(soil_year(np.zeros(len(a))) <= 0, 0.0, high)
    surplus = np.empty_like(rain)
    soil = soil_year(soil0, surplus)
    share = -np.expm1(-days / p.gw_days)

    def gw_year(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flow = 0.0
        for m in range(12):
            held = level + surplus[m] * p.seepage
            level = held - held * share[m]
            flow = flow + held * share[m]
        return level, flow

    gw0 = gw_year(np.zeros(len(a)))[0] / (1 - np.exp(-sum(MONTH_DAYS) / p.gw_days))
    gw, flow = gw_year(gw0)
    over = surplus.sum(axis=0)
    return {
        "snow": snow, "soil": soil, "gw": gw, "aet": water.sum(axis=0) + soil0 - soil - over, "runoff": over * (1 - p.seepage) + flow,
        "change": np.abs(snow - snow0) + np.abs(soil - soil0) + np.abs(gw - gw0),
    }


def periodic_year(temp: Column, rain: Column, pet: Column, stores: Stores = Stores(), halvings: int = 30) -> Column:
    """snow, soil and gw at the end of the year that repeats itself, its aet and runoff,
    and ``change``: by how much the three levels still differ from those it began with; all null where
    an array or one of its twelve values is.

    Of several such years that which empty stores come to. The soil's level is known
    to its capacity over 2 ** ``halvings``. Worked out for a batch of cells at once.
    """
    names = ["snow", "soil", "gw", "aet", "runoff", "change"]

    def settle(*months: pd.Series) -> pd.DataFrame:
        full = np.ones(len(months[0]), bool)
        for s in months:
            full &= np.fromiter((x is not None and len(x) == 12 for x in s), bool, len(s))
        out = pd.DataFrame(np.nan, index=range(len(full)), columns=names)
        if full.any():
            values = [np.stack(s.to_numpy()[full]).astype(float).T for s in months]
            found = settled_year(*values, stores, halvings)
            out.loc[full] = np.where(np.isnan(sum(values)).any(axis=0)[:, None], np.nan, np.column_stack([found[n] for n in names]))
        return out

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return F.pandas_udf(settle, kind, F.PandasUDFType.SCALAR)(temp, rain, pet)
