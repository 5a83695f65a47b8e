"""Wind and humidity formulas as Column expressions."""

from pyspark.sql import Column, functions as F

from emberline.functions.geo import _col

STANDARD_PRESSURE_PA = 101_325.0


def _clip(c: Column, lo: float, hi: float) -> Column:
    """Clip, keeping missing values missing (least and greatest skip NULL)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def wind_speed(u, v) -> Column:
    return F.hypot(u, v)


def wind_from_direction(u, v) -> Column:
    """Direction the wind blows from, degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 180, F.lit(360.0))


def wind_components(speed, from_deg) -> tuple[Column, Column]:
    theta = F.radians(from_deg)
    return -_col(speed) * F.sin(theta), -_col(speed) * F.cos(theta)


def _magnus(t_c: Column) -> Column:
    return F.exp(17.625 * t_c / (243.04 + t_c))


def relative_humidity(temp_k, dew_k) -> Column:
    return _clip(100 * _magnus(_col(dew_k) - 273.15) / _magnus(_col(temp_k) - 273.15), 0.0, 100.0)


def rh_from_specific_humidity(q, temp_k, pressure: float = STANDARD_PRESSURE_PA) -> Column:
    e_sat = 611.2 * _magnus(_col(temp_k) - 273.15)
    e = _col(q) * pressure / (0.622 + 0.378 * _col(q))
    return _clip(100 * e / e_sat, 0.0, 100.0)


def saturation_specific_humidity(temp_k, pressure: float = STANDARD_PRESSURE_PA) -> Column:
    e_sat = 611.2 * _magnus(_col(temp_k) - 273.15)
    return 0.622 * e_sat / (pressure - 0.378 * e_sat)
