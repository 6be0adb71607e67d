"""Scalar columns: guarded arithmetic, coercion, domain bands and labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite(col: Column | str) -> Column:
    """Null for NaN and infinities: a missing reading has one spelling."""
    col = _c(col)
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), None).otherwise(col)


def is_finite(col: Column | str) -> Column:
    return finite(col).isNotNull()


def number(text: Column | str) -> Column:
    """Coercing parse; bad text and NaN give null."""
    return finite(_c(text).try_cast("double"))


def clip(col: Column | str, low=None, high=None) -> Column:
    """greatest/least skip nulls, so a missing reading must be guarded."""
    col = _c(col)
    out = col
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(col.isNotNull(), out)


def safe_ratio(num: Column | str, den: Column | str, epsilon: float = 0.0) -> Column:
    return finite(F.try_divide(_c(num), _c(den) + F.lit(epsilon)))


def production_share(mw: Column | str, capacity: Column | str) -> Column:
    return F.try_divide(_c(mw), _c(capacity))


def row_values(cols: Sequence[str | Column]) -> Column:
    return F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda v: v.isNotNull())


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the present values of a row; none present gives null."""
    if not cols:
        return F.lit(None).cast("double")
    vals = row_values(cols)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def row_variance(cols: Sequence[str | Column]) -> Column:
    """Sample variance of the present values of a row; fewer than two give null."""
    if not cols:
        return F.lit(None).cast("double")
    vals, mean = row_values(cols), row_mean(cols)
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return F.when(F.size(vals) > 1, ss / (F.size(vals) - 1))


# Weather symbol codes and the severity order of their conditions.
SYMBOL_CONDITIONS = {
    "clear-day": (1,),
    "partly-cloudy-day": (2,),
    "overcast-day": (3, 91, 92),
    "rain": (21, 22, 23, 31, 32, 33),
    "snow": (41, 42, 43, 51, 52, 53, 71, 72, 73, 81, 82, 83),
    "thunderstorms-day": (61, 62, 63, 64),
}
CONDITION_SEVERITY = ("clear-day", "partly-cloudy-day", "overcast-day", "rain", "snow", "thunderstorms-day")


def weather_condition(symbol: Column | str) -> Column:
    code = number(symbol).cast("int")
    branches = [(code.isin(*codes), F.lit(name)) for name, codes in SYMBOL_CONDITIONS.items()]
    return F.coalesce(*[F.when(test, label) for test, label in branches])


def condition_severity(condition: Column | str) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CONDITION_SEVERITY]), _c(condition)) - 1).cast("int")


# Wind power level thresholds in MW.
WIND_CALM_BELOW = 1000.0
WIND_WEAK_BELOW = 2500.0
WIND_NORMAL_UP_TO = 3000.0


def wind_level(mw: Column | str) -> Column:
    mw = _c(mw)
    return (
        F.when(mw < WIND_CALM_BELOW, "calm")
        .when(mw < WIND_WEAK_BELOW, "weak")
        .when(mw <= WIND_NORMAL_UP_TO, "normal")
        .when(mw.isNotNull(), "strong")
    )


# Wind limits of the risk multiplier (MW) and its bounds.
RISK_WIND_HIGH = 1004.1304
RISK_WIND_LOW = 412.8883
RISK_MULTIPLIER_MAX = 1.3340
RISK_MULTIPLIER_MIN = 1.0


def wind_multiplier(mw: Column | str, low: float = RISK_WIND_LOW, high: float = RISK_WIND_HIGH) -> Column:
    """Linear between the two wind limits, flat outside; null stays null."""
    share = (F.lit(high) - clip(mw, low, high)) / F.lit(high - low)
    return F.lit(RISK_MULTIPLIER_MIN) + share * F.lit(RISK_MULTIPLIER_MAX - RISK_MULTIPLIER_MIN)


# Upper price edges (c/kWh) of the display bands.
PRICE_BAND_EDGES = (5.0, 10.0, 15.0, 20.0, 30.0)


def price_band(price: Column | str, edges: Iterable[float] = PRICE_BAND_EDGES) -> Column:
    """Index of the first band whose upper edge is not below the price."""
    price, edges = _c(price), list(edges)
    steps = reduce(lambda acc, ie: acc.when(price <= ie[1], ie[0]), list(enumerate(edges))[1:], F.when(price <= edges[0], 0))
    return steps.when(price.isNotNull(), len(edges))


# Unit factors (EUR/MWh to c/kWh; EUR/kWh to c/kWh with VAT; MW to GW).
EUR_MWH_TO_CKWH = 0.1
EUR_KWH_TO_CKWH_VAT = 125.5
MW_TO_GW = 0.001

# Model feature names by group.
FEATURE_GROUPS = {
    "calendar": ("year", "day_of_week_sin", "day_of_week_cos", "hour_sin", "hour_cos", "holiday"),
    "generation": ("NuclearPowerMW", "WindPowerMW"),
    "transmission": ("ImportCapacityMW", "SE1_FI", "SE3_FI", "EE_FI"),
    "solar": ("sum_irradiance", "mean_irradiance", "std_irradiance", "min_irradiance", "max_irradiance"),
    "temperature": ("temp_mean", "temp_variance"),
}
FEATURE_PREFIXES = (("Hydro", "hydrology"), ("t_", "temperature"), ("ws_", "wind_speed"), ("eu_ws_", "baltic_wind"))


def feature_group(name: Column | str) -> Column:
    """Group of a feature name: exact names, then prefixes, else calendar."""
    name = _c(name)
    exact = [F.when(name.isin(*names), group) for group, names in FEATURE_GROUPS.items()]
    prefixed = [F.when(name.startswith(prefix), group) for prefix, group in FEATURE_PREFIXES]
    return F.coalesce(*exact, *prefixed, F.lit("calendar"))


_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def plain_identifier(name: Column | str) -> Column:
    """Whether a text could be a plain column name."""
    return _c(name).rlike(_IDENTIFIER.pattern)


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not a plain column name: {name!r}")
    return name
