"""Vegetation, land cover, fuel and channel scaling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberline.functions.geo import _col
from emberline.functions.meteo import _clip

# Land-cover class -> fuel code; any other class is UNKNOWN_FUEL.
FUEL_OF_LANDCOVER = {10: 3, 20: 2, 30: 1, 40: 4, 50: 90, 60: 91, 70: 93, 80: 92, 90: 5, 95: 5, 100: 93}
UNKNOWN_FUEL = 99
# Fuel code -> flammability; any other code is 0.
FLAMMABILITY_OF_FUEL = {1: 1.0, 2: 0.8, 3: 0.6, 4: 0.3, 5: 0.1, 90: 0.0, 91: 0.0, 92: 0.0, 93: 0.0, 99: 0.0}
# Channel -> (shift, scale) of the input normalisation.
INPUT_SCALE = {
    "elevation": (0.0, 1000.0), "slope_deg": (0.0, 30.0), "aspect_deg": (0.0, 360.0),
    "wind_u": (0.0, 5.0), "wind_v": (0.0, 5.0), "temperature": (290.0, 10.0),
    "relative_humidity": (0.0, 100.0), "precipitation": (0.0, 0.01),
}
# Scene classes treated as cloud or cloud shadow.
CLOUD_CLASSES = (3, 8, 9, 10)


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def ndvi(red, nir) -> Column:
    return F.try_divide(_col(nir) - _col(red), _col(nir) + _col(red))


def ndvi_masked(red, nir, offset: float = 0.0, min_sum: float = 100.0) -> Column:
    """NDVI of offset-corrected reflectance; dark or non-positive pixels are missing."""
    r, n = _col(red) + offset, _col(nir) + offset
    return F.when((r > 0) & (n > 0) & (r + n >= min_sum), F.try_divide(n - r, n + r))


def fuel_from_landcover(landcover) -> Column:
    return F.coalesce(_lookup(FUEL_OF_LANDCOVER)[_col(landcover).cast("int")], F.lit(UNKNOWN_FUEL))


def flammability(fuel, table: dict | None = None) -> Column:
    return F.coalesce(_lookup(table or FLAMMABILITY_OF_FUEL)[_col(fuel).cast("int")], F.lit(0.0))


def normalized_inputs(mode: str = "v1") -> dict[str, Column]:
    """Expression per scaled channel; mode "none" changes nothing."""
    if mode not in ("none", "v1"):
        raise ValueError(f"input normalisation must be 'none' or 'v1', not {mode!r}")
    if mode == "none":
        return {}
    out = {c: (F.col(c) - shift) / scale for c, (shift, scale) in INPUT_SCALE.items()}
    code = F.least(F.greatest(F.bround("fuel_type", 0), F.lit(0.0)), F.lit(99.0))
    out["fuel_type"] = flammability(code)
    return out


def logit(p) -> Column:
    q = _clip(_col(p), 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def focal_loss(logits, target, alpha: float = 0.8, gamma: float = 2.0) -> Column:
    """Per-cell focal loss of a logit against a 0/1 target."""
    z, y = _col(logits), _col(target)
    bce = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    p = 1 / (1 + F.exp(-z))
    p_t = p * y + (1 - p) * (1 - y)
    a_t = alpha * y + (1 - alpha) * (1 - y)
    return a_t * F.pow(1 - p_t, gamma) * bce
