"""Sun, evaporation and climate indices by published formulas, as column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.hydrology import MONTH_DAYS

#: FAO-56's day of each month (the fifteenth) as a day of the year, and (eq. 21
#: to 25) solar constant, earth's distance and declination; Oudin et al. (2005): 5 degrees, 245.
MID_MONTH_DAY = tuple(sum(MONTH_DAYS[:m]) + 15 for m in range(12))
SOLAR, DISTANCE, TILT, PHASE = 0.0820, 0.033, 0.409, 1.39
SOLAR_WATTS = 1361.0


def hold(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def by_month(values: tuple, month: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (month + 1).cast("int"))


def daylight_term(phi: Column, delta: Column) -> Column:
    """Sunset angle and the two products of FAO-56 eq. 21, added up."""
    sunset = F.acos(hold(-F.tan(phi) * F.tan(delta), -1.0, 1.0))
    return sunset * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(sunset)


def radiation(latitude: Column, month: Column) -> Column:
    """Extraterrestrial radiation (MJ a square metre and day) of a month (0 to 11)."""
    angle = by_month(MID_MONTH_DAY, month) * (2 * pi / 365)
    term = daylight_term(F.radians(hold(latitude, -89.9, 89.9)), TILT * F.sin(angle - PHASE))
    return F.greatest((24 * 60 / pi * SOLAR) * (1 + DISTANCE * F.cos(angle)) * term, F.lit(0.0))


def evaporation(temp: Column, latitude: Column, month: Column) -> Column:
    """Potential evapotranspiration (mm a month) of Oudin et al."""
    return radiation(latitude, month) * F.greatest(temp + 5, F.lit(0.0)) / 245 * by_month(MONTH_DAYS, month)


def insolation(phi: Column, delta: Column) -> Column:
    """Daily mean at the top of the air (W a square metre), angles in radians."""
    return F.lit(SOLAR_WATTS / pi) * daylight_term(phi, delta)


def lapse_rate(precipitation: Column) -> Column:
    """Degrees a metre: steeper where it is dry."""
    return hold(-6.5 + 0.0015 * precipitation, -9.8, -4.0) / 1000


def bioclim(summer_t: Column, winter_t: Column, summer_p: Column, winter_p: Column) -> dict[str, Column]:
    """BIO1, 4, 12 and 15 from two half-years: temperatures in degrees, rain in mm. The
    sample deviation of twelve months, half of them at each value, has the factor
    sqrt(12 / 11); of a harmonic through both, over 2 sqrt(2). BIO15 has a millimetre
    a month added, as its usual definition does."""
    spread = 100 * sqrt(12 / 11)
    return {
        "bio1": (summer_t + winter_t) / 2, "bio4": F.abs(summer_t - winter_t) * (spread / (2 * sqrt(2))),
        "bio12": summer_p + winter_p, "bio15": F.abs(summer_p - winter_p) * spread / (summer_p + winter_p + 12),
    }


def flow_regime(q: Column, annual: Column, dry: float = 0.01) -> Column:
    """perennial, seasonal (under six dry months), ephemeral, or unresolved if all
    months are alike; without months, ephemeral if the year is dry, else unresolved."""
    n_dry = F.size(F.filter(q, lambda x: x < dry))
    flat = F.forall(q, lambda x: F.abs(x - q[0]) <= 1e-6 * F.greatest(annual, F.lit(1e-9)))
    of_months = F.when(n_dry >= 6, "ephemeral").when(n_dry > 0, "seasonal").when(flat, "unresolved").otherwise("perennial")
    return F.when(F.size(q) == 12, of_months).when(F.greatest(annual, F.lit(0.0)) < dry, "ephemeral").otherwise("unresolved")
