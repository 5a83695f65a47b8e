"""Geodesy as Column expressions: distances, UTM, grids, tiles, footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0
KM_PER_DEG_LAT = 110.57
KM_PER_DEG_LON = 111.32


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = (F.pow(F.sin((p2 - p1) / 2), 2)
         + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def sphere_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Cartesian position on the sphere; chords are monotone in great-circle distance."""
    p, l = F.radians(lat), F.radians(lon)
    return (EARTH_RADIUS_M * F.cos(p) * F.cos(l), EARTH_RADIUS_M * F.cos(p) * F.sin(l),
            EARTH_RADIUS_M * F.sin(p))


def chord_m(arc_m: float) -> float:
    return 2 * EARTH_RADIUS_M * math.sin(arc_m / (2 * EARTH_RADIUS_M))


class Utm:
    """Transverse Mercator of one UTM zone on WGS84 by the Kruger series to third order.

    A projection is a chain of short steps, each reading what the step before has made. On a frame
    every step is a projection of its own (the optimiser keeps them apart because a step reads its
    input several times); on an array of points every step is a `transform`. Written as one
    expression the series would repeat its inputs dozens of times and outgrow code generation.
    """

    def __init__(self, zone: int = 19, south: bool = True):
        f = 1 / 298.257223563
        n = f / (2 - f)
        self.n = n
        self.lon0 = math.radians(6 * zone - 183)
        self.e0, self.n0 = 500_000.0, 10_000_000.0 if south else 0.0
        self.scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def _forward(self):
        c = 2 * math.sqrt(self.n) / (1 + self.n)
        yield lambda v: {"sn": F.sin(F.radians(v("lat"))), "dl": F.radians(v("lon")) - self.lon0}
        yield lambda v: {"tt": F.sinh(F.atanh(v("sn")) - c * F.atanh(c * v("sn"))), "dl": v("dl")}
        yield lambda v: {"xi": F.atan2(v("tt"), F.cos(v("dl"))),
                         "eta": F.atanh(F.sin(v("dl")) / F.sqrt(1 + v("tt") * v("tt")))}

        def last(v):
            east, north = v("eta"), v("xi")
            for j, a in enumerate(self.alpha, 1):
                east = east + a * F.cos(2 * j * v("xi")) * F.sinh(2 * j * v("eta"))
                north = north + a * F.sin(2 * j * v("xi")) * F.cosh(2 * j * v("eta"))
            return {"x": self.e0 + self.scale * east, "y": self.n0 + self.scale * north}
        yield last

    def _inverse(self):
        yield lambda v: {"xi": (v("y") - self.n0) / self.scale, "eta": (v("x") - self.e0) / self.scale}

        def back(v):
            xi, eta = v("xi"), v("eta")
            for j, b in enumerate(self.beta, 1):
                xi = xi - b * F.sin(2 * j * v("xi")) * F.cosh(2 * j * v("eta"))
                eta = eta - b * F.cos(2 * j * v("xi")) * F.sinh(2 * j * v("eta"))
            return {"xi1": xi, "eta1": eta}
        yield back
        yield lambda v: {"chi": F.asin(F.sin(v("xi1")) / F.cosh(v("eta1"))), "xi1": v("xi1"), "eta1": v("eta1")}

        def last(v):
            lat = v("chi")
            for j, d in enumerate(self.delta, 1):
                lat = lat + d * F.sin(2 * j * v("chi"))
            return {"lon": F.degrees(self.lon0 + F.atan2(F.sinh(v("eta1")), F.cos(v("xi1")))), "lat": F.degrees(lat)}
        yield last

    @staticmethod
    def _on_frame(df, steps, inputs: dict, outputs: dict):
        held = df.columns
        df = df.withColumns({f"_u_{k}": _col(c) for k, c in inputs.items()})
        for step in steps:
            df = df.withColumns({f"_u_{k}": c for k, c in step(lambda n: F.col(f"_u_{n}")).items()})
        kept = [c for c in held if c not in outputs.values()]
        return df.select(*kept, *[F.col(f"_u_{k}").alias(name) for k, name in outputs.items()])

    @staticmethod
    def _on_array(points: Column, steps) -> Column:
        def struct_of(step):
            return lambda p: F.struct(*[c.alias(k) for k, c in step(lambda n: p[n]).items()])
        for step in steps:
            points = F.transform(points, struct_of(step))
        return points

    def with_xy(self, df, lon="longitude", lat="latitude", x: str = "x", y: str = "y"):
        """`df` with easting and northing of WGS84 degrees."""
        return self._on_frame(df, self._forward(), {"lon": lon, "lat": lat}, {"x": x, "y": y})

    def with_lonlat(self, df, x="x", y="y", lon: str = "lon", lat: str = "lat"):
        """`df` with longitude and latitude of UTM metres."""
        return self._on_frame(df, self._inverse(), {"x": x, "y": y}, {"lon": lon, "lat": lat})

    def points_xy(self, points: Column) -> Column:
        """Array of (lon, lat) structs -> array of (x, y)."""
        return self._on_array(points, self._forward())

    def points_lonlat(self, points: Column) -> Column:
        """Array of (x, y) structs -> array of (lon, lat)."""
        return self._on_array(points, self._inverse())


UTM19S = Utm(19, True)


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def in_bbox(lon, lat, bbox) -> Column:
    west, south, east, north = bbox
    return _col(lon).between(west, east) & _col(lat).between(south, north)


def valid_coordinates(lat, lon) -> Column:
    return _col(lat).between(-90, 90) & _col(lon).between(-180, 180)


def snap_down(v, res) -> Column:
    return F.floor(v / res) * res


def snap_up(v, res) -> Column:
    return F.ceil(v / res) * res


def cell_centre(v, res: float) -> Column:
    """Centre of the cell of size `res` that holds coordinate `v`."""
    return (F.floor(_col(v) / res) + 0.5) * res


# Public file names of elevation (1 degree) and land-cover (3 degree) tiles.
TILE_FORMATS = {"elevation": (1, "Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM"),
                "landcover": (3, "ESA_WorldCover_10m_2021_v200_%s%02d%s%03d_Map")}


def tile_name(kind: str, lat, lon) -> Column:
    lat, lon = _col(lat), _col(lon)
    return F.format_string(TILE_FORMATS[kind][1], F.when(lat < 0, "S").otherwise("N"), F.abs(lat),
                           F.when(lon < 0, "W").otherwise("E"), F.abs(lon))


def tiles(kind: str, west, south, east, north) -> Column:
    """Array of tiles (south-west lat, lon, name) a box touches; a tile is open at its upper edges."""
    step = TILE_FORMATS[kind][0]

    def corners(lo, hi):
        first = (F.floor(_col(lo) / step) * step).cast("int")
        last = ((F.ceil(_col(hi) / step) - 1) * step).cast("int")
        return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    lons = corners(west, east)
    return F.flatten(F.transform(corners(south, north), lambda a: F.transform(lons, lambda o: F.struct(
        a.alias("lat"), o.alias("lon"), tile_name(kind, a, o).alias("name")))))


def bbox_text(west, south, east, north) -> Column:
    return F.concat_ws(",", *[_col(c).cast("string") for c in (west, south, east, north)])


def bbox_wkt(west, south, east, north) -> Column:
    w, s, e, n = (_col(c).cast("string") for c in (west, south, east, north))
    corner = lambda x, y: F.concat(x, F.lit(" "), y)
    ring = F.concat_ws(", ", corner(w, s), corner(w, n), corner(e, n), corner(e, s), corner(w, s))
    return F.concat(F.lit("SRID=4326;POLYGON(("), ring, F.lit("))"))


def footprint_gap_km(a: str, b: str) -> Column:
    """Planar gap between two lon/lat boxes given as column prefixes, 0 when they touch."""
    c = lambda p, n: F.col(f"{p}{n}")
    mean_lat = (c(a, "south") + c(a, "north") + c(b, "south") + c(b, "north")) / 4
    dx = F.greatest(F.lit(0.0), F.greatest(c(a, "west"), c(b, "west")) - F.least(c(a, "east"), c(b, "east")))
    dy = F.greatest(F.lit(0.0), F.greatest(c(a, "south"), c(b, "south")) - F.least(c(a, "north"), c(b, "north")))
    return F.hypot(dx * KM_PER_DEG_LON * F.cos(F.radians(mean_lat)), dy * KM_PER_DEG_LAT)


def footprint_gap_days(a: str, b: str) -> Column:
    c = lambda p, n: F.col(f"{p}{n}")
    return F.greatest(F.lit(0), F.datediff(F.greatest(c(a, "first_day"), c(b, "first_day")),
                                           F.least(c(a, "last_day"), c(b, "last_day"))))


def cell_ring(row, col, x0, y0, res, utm: Utm = UTM19S, decimals: int = 6) -> Column:
    """Closed WGS84 ring (array of [lon, lat]) of a grid cell."""
    corners = F.array(*[F.struct((_col(x0) + _col(res) * (_col(col) + c)).alias("x"),
                                 (_col(y0) - _col(res) * (_col(row) + r)).alias("y"))
                        for r, c in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))])
    return F.transform(utm.points_lonlat(corners), lambda p: F.array(F.bround(p["lon"], decimals), F.bround(p["lat"], decimals)))
