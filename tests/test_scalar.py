import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalar as S


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_wind_multiplier_at_its_corners(frame):
    low, high = S.RISK_WIND_LOW, S.RISK_WIND_HIGH
    df = frame([(high,), ((low + high) / 2,), (low,), (10.0,), (5000.0,), (None,)], "w double")
    got = values(df, S.wind_multiplier("w"))
    assert got[:5] == pytest.approx([1.0, 1.167, 1.334, 1.334, 1.0])
    assert got[5] is None


def test_missing_reading_stays_missing_when_clipped(frame):
    df = frame([(-5.0,), (None,), (7.0,), (99.0,)], "v double")
    assert values(df, S.clip("v", 0, 50)) == [0.0, None, 7.0, 50.0]


def test_number_coerces(frame):
    df = frame([("1.5",), ("NaN",), ("bad",), ("inf",), (None,), ("-0.25",)], "x string")
    assert values(df, S.number("x")) == [1.5, None, None, None, None, -0.25]


def test_price_band_edges_belong_below(frame):
    df = frame([(4.99,), (5.0,), (5.01,), (30.0,), (30.1,), (-3.0,), (None,)], "p double")
    assert values(df, S.price_band("p")) == [0, 0, 1, 4, 5, 0, None]


def test_wind_level(frame):
    df = frame([(999.9,), (1000.0,), (2500.0,), (3000.0,), (3000.1,), (None,)], "w double")
    assert values(df, S.wind_level("w")) == ["calm", "weak", "normal", "normal", "strong", None]


def test_weather_condition(frame):
    df = frame([(1.0,), (2.0,), (91.0,), (32.0,), (73.0,), (64.0,), (55.0,), (None,)], "s double")
    assert values(df, S.weather_condition("s")) == [
        "clear-day", "partly-cloudy-day", "overcast-day", "rain", "snow", "thunderstorms-day", None, None,
    ]


def test_row_statistics(frame):
    df = frame([(1.0, None, 3.0), (4.0, None, None), (None, None, None)], "a double, b double, c double")
    assert values(df, S.row_mean(["a", "b", "c"])) == [2.0, 4.0, None]
    assert values(df, S.row_variance(["a", "b", "c"])) == [2.0, None, None]


def test_safe_ratio(frame):
    df = frame([(1.0, 0.0), (1.0, 4.0), (None, 1.0)], "a double, b double")
    assert values(df, S.safe_ratio("a", "b")) == [None, 0.25, None]


def test_feature_group(frame):
    df = frame([(n,) for n in ("hour_sin", "WindPowerMW", "t_101", "ws_102", "eu_ws_EE", "temp_mean", "HydroX", "SE1_FI", "other")], "n string")
    assert values(df, S.feature_group("n")) == [
        "calendar", "generation", "temperature", "wind_speed", "baltic_wind", "temperature", "hydrology", "transmission", "calendar",
    ]


def test_identifier():
    assert S.check_identifier("ws_100") == "ws_100"
    with pytest.raises(ValueError):
        S.check_identifier("a b; drop")


def test_finite(frame):
    df = frame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert values(df, F.coalesce(S.finite("v"), F.lit(-1.0))) == [-1.0, -1.0, 1.0]
