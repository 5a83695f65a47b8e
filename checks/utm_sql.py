"""UTM zone 19 south as SQL text (Kruger series), for the SQL side of grid queries."""

import math

_f = 1 / 298.257223563
_n = _f / (2 - _f)
_k = 0.9996 * 6378137.0 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_alpha = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
_beta = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
_delta = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
_L0 = math.radians(-69.0)


def _num(v: float) -> str:
    return f"({v!r}::double)"


def lonlat(source: str, name: str = "lonlat", x: str = "x", y: str = "y", tag: str = "") -> str:
    """CTEs ending in `name`: rows of `source` with lon and lat of its x and y."""
    xi = "xi0" + "".join(f" - {_num(b)} * sin({2*j} * xi0) * cosh({2*j} * eta0)" for j, b in enumerate(_beta, 1))
    eta = "eta0" + "".join(f" - {_num(b)} * cos({2*j} * xi0) * sinh({2*j} * eta0)" for j, b in enumerate(_beta, 1))
    lat = "chi" + "".join(f" + {_num(d)} * sin({2*j} * chi)" for j, d in enumerate(_delta, 1))
    return f"""u0{tag} as (select *, ({y} - 10000000) / {_num(_k)} as xi0, ({x} - 500000) / {_num(_k)} as eta0 from {source}),
u1{tag} as (select *, {xi} as xi1, {eta} as eta1 from u0{tag}),
u2{tag} as (select *, asin(sin(xi1) / cosh(eta1)) as chi from u1{tag}),
{name} as (select * exclude (xi0, eta0, xi1, eta1, chi), degrees({_num(_L0)} + atan2(sinh(eta1), cos(xi1))) as lon, degrees({lat}) as lat from u2{tag})"""


def utm(source: str, name: str = "utm", lon: str = "longitude", lat: str = "latitude", tag: str = "") -> str:
    """CTEs ending in `name`: rows of `source` with x and y of its lon and lat."""
    c = _num(2 * math.sqrt(_n) / (1 + _n))
    east = "eta" + "".join(f" + {_num(a)} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, a in enumerate(_alpha, 1))
    north = "xi" + "".join(f" + {_num(a)} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, a in enumerate(_alpha, 1))
    return f"""v0{tag} as (select *, sin(radians({lat})) as sn, radians({lon}) - {_num(_L0)} as dl from {source}),
v1{tag} as (select *, sinh(atanh(sn) - {c} * atanh({c} * sn)) as tt from v0{tag}),
v2{tag} as (select *, atan2(tt, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + tt * tt)) as eta from v1{tag}),
{name} as (select * exclude (sn, dl, tt, xi, eta), 500000 + {_num(_k)} * ({east}) as x, 10000000 + {_num(_k)} * ({north}) as y from v2{tag})"""
